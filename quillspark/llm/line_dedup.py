"""Removal of lines that many sites share.

A line's spread is the number of distinct sources that have it. Lines that one source alone has can't be spread and leave after
an aggregation of least and greatest source. The others get a HyperLogLog sketch each, merged by aggregation; lines whose
estimate is too near the threshold for the sketch's error get an exact distinct count. For the lines spread over LEAST_SITES or
more the count is then taken over distinct texts: a group of equal and near-equal texts counts with one source, so that a text
copied over many sources keeps its own lines. Lines that are still spread are boilerplate and leave every text that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_texts
from .common import saved

LEAST_SITES = 4
LOG_BUCKETS = 10  # of a sketch; its standard error is about 1.04 / 2**5 = 3.3 %
BAND = 0.1  # estimates within three standard errors of the threshold are counted exactly
LEAST_CHARS = 20  # shorter lines (list marks, headings) repeat by chance


def line_key(line: Column) -> Column:
    """The line without white space at its ends, hashed."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(x) >= LEAST_CHARS)


def _spread(rows: DataFrame, least_sites: int) -> DataFrame:
    """(key, sites) of the keys of the distinct rows (key, site) that ``least_sites`` have."""
    sketched = rows.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS)).alias("h")).select("key", F.hll_sketch_estimate("h").alias("sites"))
    sketched = saved(sketched)
    near = sketched.filter((F.col("sites") >= least_sites * (1 - BAND) - 1) & (F.col("sites") <= least_sites * (1 + BAND) + 1))
    exact = rows.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("sites"))
    sure = sketched.filter(F.col("sites") > least_sites * (1 + BAND) + 1)
    return sure.unionByName(exact.filter(F.col("sites") >= least_sites))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = LEAST_SITES) -> DataFrame:
    """(key, sites) of the lines to remove; ``sites`` is over distinct texts, exact near the threshold, else the sketch's estimate."""
    site, text = F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit(""))), F.col(text_col)
    lines = docs.select(site.alias("site"), near_texts.text_key(text).alias("node"), F.explode(F.array_distinct(F.transform(_lines(text), line_key))).alias("key"))
    shared = saved(lines.groupBy("key").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.count("*").alias("n")).filter(
        (F.col("a") != F.col("b")) & (F.col("n") >= least_sites)).select("key"))
    # one row for each (line, text, site): copies within a site are one
    held = saved(lines.join(shared, "key", "left_semi").groupBy("key", "node", "site").count().select("key", "node", "site"))
    wide = saved(_spread(saved(held.select("key", "site").distinct()), least_sites).select("key"))
    held = saved(held.join(wide, "key", "left_semi"))
    texts = docs.select(near_texts.text_key(text).alias("node"), text.alias("text")).join(held.select("node").distinct(), "node", "left_semi")
    grouped = held.join(near_texts.groups(texts), "node", "left").select("key", "site", F.coalesce("root", "node").alias("root"))
    # any one site of a group's, but not the same for all groups
    once = grouped.groupBy("key", "root").agg(F.min_by("site", F.xxhash64("site", "root")).alias("site"))
    return _spread(saved(once.select("key", "site").distinct()), least_sites)


def remove(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", least_sites: int = LEAST_SITES, n_chars_col: str | None = None, removed_col: str | None = None) -> DataFrame:
    """The rows with boilerplate lines cut from their texts.

    Texts without such a line are unchanged, null and empty texts too; a text may end empty. Null sources are one site, that of empty ones.
    Rows of the same doc_id lose the lines that any of them has among the boilerplate, as keys go by doc_id; a null doc_id's text stays.
    ``removed_col`` adds the number of lines cut, ``n_chars_col`` names a column to set to the new length. No other column is read or changed.
    """
    bad = boilerplate(docs, site_col, text_col, least_sites)
    held = docs.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), line_key))).alias("key"))
    by_doc = held.join(bad.select("key"), "key").groupBy("__id").agg(F.collect_set("key").alias("__bad"))
    bad, key = (next(n for n in (f"{x}{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("bad", "id"))
    by_doc = by_doc.select(F.col("__id").alias(key), F.col("__bad").alias(bad))
    joined = docs.join(by_doc, docs[id_col] == by_doc[key], "left")
    parts, cut = F.split(F.col(text_col), "\n"), F.col(bad)
    kept = F.filter(parts, lambda x: (F.length(x) < LEAST_CHARS) | ~F.array_contains(cut, line_key(x)))
    text = F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    cols = [text.alias(c) if c == text_col else F.when(cut.isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c) if c == n_chars_col else F.col(c) for c in docs.columns]
    if removed_col:
        cols.append(F.when(cut.isNull(), 0).otherwise(F.size(parts) - F.size(kept)).cast("long").alias(removed_col))
    return joined.select(cols)
