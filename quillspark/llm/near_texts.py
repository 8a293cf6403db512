"""Groups of near-equal texts: five-word shingles, candidates by bands of minima, checked by the Jaccard index.

``groups`` is by estimates. A text's sketch is its least SKETCH shingle hashes; BANDS keys of ROWS minima each come from it. Texts
that share a key are compared, every pair of them: at likeness 0.8 a pair meets in some band with a probability of about 99.5 %.

``verified`` is exact. If sets of a and b shingles have an index of t or more, they share t * max(a, b) and more, so that, all shingles
being in one order, the first a - ceil(t * a) + 1 of the one and the first b - ceil(t * b) + 1 of the other share one (``met``).
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, remove, saved, width, words_of
from .simhash import components

SHINGLE, LEAST = 5, 0.8
SKETCH, BANDS, ROWS = 64, 10, 4
SURE = 0.1  # about two standard errors of a sketch's estimate at 0.8
SAMPLE, COMMON = 10_000, 1 << 16  # texts looked at for common shingles, which come last in the order; at most so many of them
_SEEDS = [[random.Random(f"{b} {r}").getrandbits(63) for r in range(ROWS)] for b in range(2 * BANDS)]


def text_key(text: Column) -> Column:
    """The node of a text: equal texts are one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: Column) -> Column:
    """The distinct hashes of the runs of SHINGLE words, in order of size; a shorter text has one, of all its words."""
    runs = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (SHINGLE - 1), F.lit(1))), lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, SHINGLE)]))
    return F.sort_array(F.array_distinct(let(words_of(F.lower(text)), runs)))


def sketch(text: Column) -> Column:
    return F.slice(shingles(text), 1, SKETCH)


def _bands(sk: Column, bands: int) -> Column:
    least = lambda x, c: F.array_min(F.transform(x, lambda h: h.bitwiseXOR(F.lit(c))))
    return let(F.transform(sk, lambda h: F.xxhash64(h)), lambda x: F.array(*[F.xxhash64(F.lit(b), *[least(x, c) for c in cs]) for b, cs in enumerate(_SEEDS[:bands])]))


def estimate(a: Column, b: Column) -> Column:
    """The Jaccard index that two sketches tell; exact for texts of at most SKETCH shingles together."""
    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))


def pairs(sketches: DataFrame, least: float, bands: int = BANDS) -> DataFrame:
    """Pairs a < b of the nodes of (node, sk) that meet in a band and whose estimate is ``least`` or more, once each."""
    keys = saved(sketches.filter(F.size("sk") > 0).select("node", F.explode(_bands(F.col("sk"), bands)).alias("key")))
    shared = keys.join(keys.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi")
    met = shared.withColumnRenamed("node", "a").join(shared.withColumnRenamed("node", "b"), "key").filter("a < b").select("a", "b").distinct()
    told = met.join(sketches.select(F.col("node").alias("a"), F.col("sk").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sk").alias("sb")), "b")
    return told.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b")


def groups(texts: DataFrame) -> DataFrame:
    """(node, root) of each distinct text of (node, text) that has a near-equal one, by the sketches' estimates."""
    own = saved(texts.select("node", sketch(F.col("text")).alias("sk")).groupBy("node").agg(F.first("sk").alias("sk")))
    return components(pairs(own, LEAST - SURE).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _rest(n, least: float):
    """How many of a set's n shingles are behind its prefix."""
    return np.ceil(least * n - 1e-9).astype(np.int64) - 1


def _prefixes(common: np.ndarray, least: float):
    """(key, node, n) of the shingles in each set's prefix; the order is that of the hashes, ``common`` ones behind all others."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                node, sets = b.slice(at, 500).columns
                n, key = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
                row, start = np.repeat(np.arange(len(n)), n), np.r_[0, np.cumsum(n)[:-1]]
                late = np.zeros(len(key), bool)
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
                order = np.lexsort((late, row))  # stable: the hashes are in order
                on = np.arange(len(key)) - start[row] < (n - _rest(n, least))[row]
                row = row[on]
                yield pa.RecordBatch.from_arrays([pa.array(key[order][on]), pa.array(node.to_numpy()[row]), pa.array(n[row].astype(np.int32))], names=["key", "node", "n"])

    return run


def _meet(least: float):
    """A row (a, b, na, nb) for each key that two nodes a < b share, if their sizes allow the index ``least``; every pair of a key."""

    def run(batches):
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        key, node, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((node, key))
        key, node, n = key[order], node[order], n[order]
        on = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, n = key[on], node[on], n[on]
        i, d, held, size = np.arange(len(key)), 1, [], 0
        while True:
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            near = i[np.minimum(n[i], n[i + d]) >= least * np.maximum(n[i], n[i + d]) - 1e-9]
            held.append((node[near], node[near + d], n[near], n[near + d]))
            size, d = size + len(near), d + 1
            if size and (size > 100_000 or not len(i)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["a", "b", "na", "nb"])
                held, size = [], 0
            if not len(i):
                return

    return run


def met(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs a < b of the nodes of (node, text), among them every one of a Jaccard index of ``least`` or more, once each.

    Common shingles of a sample come last in the order, which keeps the keys' groups small and leaves out no pair: any order will do.
    Shingles that both sets have and that aren't in both prefixes are behind the prefix that ends first. So what two sets share is no
    more than what their prefixes share and the longer rest; pairs that this keeps under the index go.
    """
    spark = texts.sparkSession
    share = min(1.0, SAMPLE / max(1, texts.count()))
    often = texts.sample(share, 1).select(F.explode(shingles(F.col("text"))).alias("h")).groupBy("h").count().filter("count >= 4")
    common = np.sort(np.array([r.h for r in often.orderBy(F.desc("count"), "h").limit(COMMON).collect()], np.int64))
    sets = texts.select("node", shingles(F.col("text")).alias("s")).filter(F.size("s") > 0)
    keys = sets.mapInArrow(_prefixes(common, least), "key long, node long, n int")
    both = keys.repartition(width(spark), "key").mapInArrow(_meet(least), "a long, b long, na int, nb int")
    rest = lambda n: F.ceil(least * F.col(n) - 1e-9) - 1
    counted = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return counted.filter(F.col("c") + F.greatest(rest("na"), rest("nb")) >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b")


def verified(texts: DataFrame, more: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Pairs a < b of the distinct texts of (node, text) whose Jaccard index, over all shingles, is ``least`` or more: all of them.

    Candidates are those of ``met``, and those of ``more`` (a, b).
    """
    found = met(texts, least)
    if more is not None:
        found = found.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")).distinct()
    found = saved(found)
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    full = saved(texts.join(ends, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).select("node", shingles(F.col("text")).alias("s")))
    both = found.join(full.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    near = saved(both.filter((F.size("sa") > 0) & (F.size("sb") > 0) & (common >= least * (F.size("sa") + F.size("sb") - common))).select("a", "b"))
    remove(full)
    remove(found)
    return near
