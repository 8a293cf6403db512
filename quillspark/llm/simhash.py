"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within ``tau`` bits differ in at most t_i bits in some part i, where the t_i sum to tau - parts + 1. Parts group
correlated bits; a dynamic programme gives each part its t_i so that the estimated candidates and probes are fewest. The estimates
come from all fingerprints. Candidates meet in a join on a part's value and are verified in that join.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved

SHINGLE = 4
_MASK = 2**64 - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint; a text without words has 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), 42)]
    else:
        data, at, starts = b" ".join(words), 0, []
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s - 1 for s in starts[shingle:]] + [len(data)]
        hashes = [h(data[s:e], 42) for s, e in zip(starts, ends)]
    x = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(x), 8192):
        ones += np.unpackbits(x[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(fps: DataFrame, rows_of, names: str) -> dict:
    """Sums, over all fingerprints, of what rows_of(list of arrays) counts by (a, b); a table of bounded size."""

    def run(batches):
        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if parts:
            rows = rows_of(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "n"])

    return {(r.a, r.b): r.n for r in fps.select("fp").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


CHUNK = 1 << 16  # fingerprints whose bits are unpacked at once


def _both(fp: np.ndarray):
    c = np.zeros((64, 64))
    for i in range(0, len(fp), CHUNK):
        m = _bits(fp[i : i + CHUNK]).astype(np.float32)
        c += m.T @ m  # whole numbers below 2**24 in each product
    return [(i, j, int(c[i, j])) for i in range(64) for j in range(i, 64)] + [(64, 64, len(fp))]


def group_bits(together: dict, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups: each starts at the strongest free pair and takes the bit that correlates most with it."""
    n = max(1, together.get((64, 64), 0))
    p = np.array([together.get((i, i), 0) / n for i in range(64)])
    c = np.zeros((64, 64))
    for i, j in combinations(range(64), 2):
        sd = (p[i] * (1 - p[i]) * p[j] * (1 - p[j])) ** 0.5
        c[i, j] = c[j, i] = abs(together.get((i, j), 0) / n - p[i] * p[j]) / sd if sd > 0 else 0
    free, groups = set(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        a = max(free, key=lambda i: (max([c[i, j] for j in free if j != i], default=0), -i))
        group = [a]
        free.remove(a)
        while len(group) < size:
            b = max(free, key=lambda i: (c[i, group].sum(), -i))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], units: int) -> tuple[float, list[int]]:
    """The thresholds, -1 (unused) and up, of least total cost, whose sum with 1 added to each is ``units``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for u in range(units - used + 1):
                x = (total + (c[u - 1] if u else 0.0), [*ts, u - 1])
                if used + u not in new or x < new[used + u]:
                    new[used + u] = x
        best = new
    return best[units]


def plan(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """The parts and thresholds for these distinct fingerprints, (bits, t) each."""
    together = _sums(fps, _both, "i j")
    n = together.get((64, 64), 0)
    choices = [group_bits(together, m) for m in range(2, tau + 2)]
    flat = [g for gs in choices for g in gs]

    def near(fp):
        rng = np.random.default_rng(1)
        count = np.zeros((len(flat), tau + 1), np.int64)
        for i in range(0, len(fp), CHUNK):
            m = _bits(fp[i : i + CHUNK])
            for _ in range(4):  # each fingerprint against four others
                x = m ^ m[rng.permutation(len(m))]
                for k, g in enumerate(flat):
                    count[k] += np.bincount(np.minimum(x[:, g].sum(1), tau + 1), minlength=tau + 2)[: tau + 1]
        rows = [(k, t, int(count[k, t])) for k in range(len(flat)) for t in range(tau + 1)]
        return [*rows, (-1, -1, 4 * len(fp))]

    seen = _sums(fps, near, "k t")
    pairs, k, found = max(1, seen.get((-1, -1), 1)), 0, []
    for groups in choices:
        cost = []
        for g in groups:
            ball = [sum(comb(len(g), s) for s in range(t + 1)) for t in range(tau + 1)]
            share = [max(sum(seen.get((k, s), 0) for s in range(t + 1)) / pairs, ball[t] / 2 ** len(g)) for t in range(tau + 1)]
            cost.append([n * n / 2 * share[t] + 4.0 * n * ball[t] for t in range(tau + 1)])
            k += 1
        total, ts = allocate(cost, tau + 1)
        found.append((total, list(zip(groups, ts))))
    return [(g, t) for g, t in min(found)[1] if t >= 0]


def links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``fp`` within tau bits, once each. No candidate is left out."""
    parts = plan(fps, tau)

    def mask(bits) -> int:
        m = sum(1 << b for b in bits)
        return m - 2**64 if m >> 63 else m

    held = probes = None
    for k, (bits, t) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(mask(bits)))
        flips = [mask(c) for s in range(t + 1) for c in combinations(bits, s)]
        h = fps.select(F.lit(k).alias("part"), value.alias("value"), F.col("fp").alias("b"))
        p = fps.select(F.lit(k).alias("part"), F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: x.bitwiseXOR(F.col("fp").bitwiseAND(F.lit(mask(bits)))))).alias("value"), F.col("fp").alias("a"))
        held, probes = (h, p) if held is None else (held.unionByName(h), probes.unionByName(p))
    pairs = probes.join(held, ["part", "value"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau))
    return pairs.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); root is the least node reachable. Large-star and small-star rounds on written tables."""
    e = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    was = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        old, e = e, saved(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        remove(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
    stars = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, tau: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the least doc_id that links reach.

    Equal fingerprints are one node, so groups of copies never form pairs. Null and empty texts share fingerprint 0.
    Rows with the same doc_id are each returned; a null doc_id takes part by its fingerprint and never names a component
    that has another id.
    """
    own = saved(fingerprints(docs, id_col, text_col, shingle))
    nodes = saved(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = saved(links(nodes.select("fp"), tau))
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, tau: int = 6, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of near copies, the one of least id, with the columns of the input.

    Texts are near copies if the Jaccard index of their sets of ``shingle``-word runs is ``least`` or more, and by what such pairs link.
    Pairs come from the pigeonhole search, in which one text stands for those of its fingerprint: it with each of them, and with those
    that stand for fingerprints within ``tau`` bits. The rest, further apart or of others than these, comes from the prefixes of
    ``near_texts``, which meet for every pair of that index. Every pair is verified on all shingles, so no other text goes and no link
    is lost. Equal texts are one node: groups of copies form no pairs. Texts without words are near to equal ones only. Rows of a
    group that all lack an id leave one; of repeated rows one stays.
    """
    from . import near_texts

    idc, text = F.col(id_col), F.col(text_col)
    node = near_texts.text_key(text)
    texts = docs.select(node.alias("node"), text.alias("text"))
    marked = saved(fingerprints(docs.select(F.struct(idc.alias("id"), node.alias("node")).alias("k"), text.alias("text")), "k", "text", shingle).select("doc_id.id", "doc_id.node", "fp"))
    by_fp = saved(marked.groupBy("fp").agg(F.min("node").alias("rep")))
    within = marked.join(by_fp, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    across = links(by_fp.select("fp"), tau)
    across = across.join(by_fp.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = near_texts.verified(texts, within.unionByName(across), least)
    roots = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = marked.groupBy("id", "node").agg(F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "n")).alias("m"))
    kept = saved(best.select(F.col("m.id").alias("_id"), F.col("m.node").alias("_node"), F.col("m.n").alias("_n")))
    for table in (marked, by_fp, near):
        remove(table)
    pick = lambda rows: docs.join(rows, idc.eqNullSafe(F.col("_id")) & (node == F.col("_node")), "left_semi")
    twice = kept.filter("_n > 1")
    return pick(kept.filter("_n = 1")).unionByName(pick(twice).dropDuplicates([id_col, text_col]))
