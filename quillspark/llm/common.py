"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, saved, shared_dir  # noqa: F401

#: The separators of "words": the ASCII white space only.
WS = "\\x20\\x09-\\x0D"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as one expression that adds no column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]"), lambda w: w != "")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
