"""Keyword-in-context snippets, made for the few rows that a search returns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import analyze, spans

TAGS = {"html": ("<b>", "</b>"), "ansi": ("\x1b[1;33m", "\x1b[0m"), "plain": ("", "")}


class _Bytes:
    """A text whose places are UTF-8 bytes."""

    def __init__(self, text: str):
        self.text = text
        self.at = [0]
        for c in text:
            self.at.append(self.at[-1] + len(c.encode()))
        self.size = self.at[-1]
        self.back = {b: i for i, b in enumerate(self.at)}

    def floor(self, b: int) -> int:
        b = min(b, self.size)
        while b not in self.back:
            b -= 1
        return b

    def ceil(self, b: int) -> int:
        b = min(b, self.size)
        while b not in self.back:
            b += 1
        return b

    def cut(self, a: int, b: int) -> str:
        return self.text[self.back[a] : self.back[b]]


def opening(text: str, most: int) -> str:
    """The first ``most`` characters, back to the last white space."""
    if len(text) <= most:
        return text
    head = text[:most]
    spot = max((i for i, c in enumerate(head) if c.isspace()), default=-1)
    return (head if spot < 0 else head[:spot]) + " ..."


def _snap(t: _Bytes, start: int, end: int) -> tuple[int, int]:
    start, end = t.floor(start), t.ceil(end)
    if start > 0:
        spot = next((i for i in range(t.back[start], len(t.text)) if t.text[i].isspace()), None)
        if spot is not None and t.at[spot] + 1 < end:
            start = t.at[spot] + 1
    if end < t.size:
        spot = next((i for i in range(t.back[end] - 1, -1, -1) if t.text[i].isspace() or t.text[i] in ".!?"), None)
        if spot is not None and t.at[spot] > start:
            end = t.at[spot] + (1 if t.text[spot] in ".!?" else 0)
    start, end = t.floor(start), t.ceil(end)
    return (start, end) if start < end else (0, t.ceil(min(t.size, start + 50)))


def snippet(text: str | None, query: str | set[str], most: int = 180, tags: str | tuple[str, str] = "html") -> str:
    """The window with most matches of the query's terms, marked; ``...`` where text is left out.

    A window of ``most`` bytes is laid around each match and snapped to words; distinct terms count 100, matches 10, earlier windows
    up to a tenth more. A text without a match gives its beginning.
    """
    text = (text or "").strip()
    if not text:
        return ""
    wanted = set(analyze(query)) if isinstance(query, str) else query
    t = _Bytes(text)
    hits = [(w, t.at[a], t.at[b]) for w, a, b in spans(text) if w in wanted] if wanted else []
    if not hits:
        return opening(text, most)
    if len(text) <= most:
        start, end = 0, t.size
    else:
        best, start, end = -1.0, 0, min(most, t.size)
        for _, a, b in hits:
            mid = (a + b) // 2
            s, e = _snap(t, max(0, mid - most // 2), min(mid + most // 2, t.size))
            inside = [w for w, x, y in hits if x >= s and y <= e]
            score = (100.0 * len(set(inside)) + 10.0 * len(inside)) * (1 - s / (t.size + 1) * 0.1)
            if score > best:
                best, start, end = score, s, e
    open_, close = TAGS[tags] if isinstance(tags, str) else tags
    out, at = ["... " if start else ""], start
    for _, a, b in hits:
        if a >= start and b <= end:
            out += [t.cut(at, a), open_, t.cut(a, b), close]
            at = b
    return "".join([*out, t.cut(at, end), " ..." if end < t.size else ""])


def snippet_udf(text, query: str, most: int = 180, tags="html") -> Column:
    wanted = set(analyze(query))
    return F.pandas_udf(lambda s: pd.Series([snippet(x, wanted, most, tags) for x in s], dtype=object), "string")(text)


def opening_sql(text: Column, most: int) -> Column:
    """``opening`` by built-ins."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, "(?s)^(.*)\\s", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(head.rlike("(?s)^.*\\s"), cut).otherwise(head), F.lit(" ...")))
