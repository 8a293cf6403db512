"""Structured Streaming: pages that arrive are indexed as they come."""
