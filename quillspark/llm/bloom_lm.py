"""Language-model scores from a log-frequency Bloom filter of word and word-pair counts.

Counts are quantised to powers of two: an n-gram is in the filter once for each level up to 1 + floor(log2 c), so that probing level after
level until one is absent gives the level back. All bits of an n-gram lie in one segment, and each segment is built by one task from packed,
pre-summed hashes. The filter has BITS bits an entry, whatever the number of entries: no n-gram is left out. It is one file in the shared
folder, which the workers of a machine map into memory together; so it costs them page cache and no heap, and its size may grow with
the corpus up to what a machine's disk holds. Exact counts of tokens, which the base score takes, aren't bounded: the commonest at most
HEAVY words go to the workers, all others meet their counts in a join on the word's 64-bit hash.

P(w | v) = (low(v w) + THETA P(w)) / (high(v) + THETA) and P(w) = (low(w) + 0.1) / (N + 0.1 (V + 1)): ``low`` is the least and ``high`` the
greatest count of the level read, both are the count itself for the HEAVY words. The low counts of a word's pairs sum to no more than
its count, so the probabilities of the words behind a word sum to at most 1, as far as the filter has no false positives (about 3 in 100
of the pairs that never came, which then count as seen once).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir

BITS, PROBES, LEVELS = 8, 3, 32
SEGMENT_BYTES = 1 << 22  # training text of a segment
HEAVY = 1 << 17
PACKED = 1 << 21  # tokens counted at once
THETA = 4.0  # weight of the words' own distribution against the pairs
_U = np.uint64
END = xxhash.xxh64_intdigest(b"\n", 42)  # no word holds a line feed


def token_hashes(text: str | None) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    out = [h(w, 42) for w in (text or "").encode().lower().split()]
    out.append(END)
    return np.array(out, _U)


def pair_hashes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before; at ``first``, where a text begins, that is the end mark."""
    before = np.r_[tokens[:1], tokens[:-1]]
    before[first] = _U(END)
    x = (before * _U(0x9E3779B97F4A7C15) ^ (before >> _U(29))) + tokens
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _positions(h: np.ndarray, level: int, mask: int) -> list[np.ndarray]:
    x = (h ^ _U(level * 0xA24BAED4963EE407 & (2**64 - 1))) * _U(0x9FB21C651E98DF25)
    x ^= x >> _U(28)
    step = (x >> _U(33)) | _U(1)
    return [((x + _U(i) * step) & _U(mask)).astype(np.int64) for i in range(PROBES)]


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of hashes, so that hashes in order are in order of their segments too."""
    return ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)


class Filter:
    """Reads the bits, from a file that is mapped or from bytes."""

    def __init__(self, bits, segments: int, segment_bits: int):
        self.bits = np.frombuffer(bits, np.uint8) if isinstance(bits, bytes) else np.memmap(bits, np.uint8, "r")
        self.segments, self.size = segments, segment_bits

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram's count; 0 if it is absent."""
        out = np.zeros(len(h), np.int64)
        on, base = np.arange(len(h)), _segment(h, self.segments) * self.size
        for level in range(1, LEVELS):
            there = np.ones(len(h), bool)
            for p in _positions(h, level, self.size - 1):
                p += base
                there &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            h, base, on = h[there], base[there], on[there]
            if not len(h):
                break
            out[on] = level
        return out


def low(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, np.exp2(levels - 1.0), 0.0)


def high(levels: np.ndarray) -> np.ndarray:
    return np.exp2(levels) - 1.0


@lru_cache(maxsize=1)
def _mapped(path: str, remote: bool, segments: int, segment_bits: int) -> Filter:
    return Filter(SparkFiles.get(path) if remote else path, segments, segment_bits)


def _publish(spark, parts, size: int) -> tuple[str, bool]:
    """Writes the segments (number, bits), ``size`` bytes each, to one file; how the workers find it. One segment at a time is here."""
    path = f"{shared_dir(spark)}.filter"
    if re.match("file:|/", path):
        local = re.sub("^file:/*", "/", path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            for number, bits in parts:
                f.seek(number * size)
                f.write(bits)
        return local, False
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    for _, bits in parts:  # in the order of their numbers
        out.write(bytearray(bits))
    out.close()
    spark.sparkContext.addFile(path)  # executors fetch it once a machine
    return path.rsplit("/", 1)[1], True


def _count_batches(batches, segments: int):
    """Packs the sums of each segment's n-grams: (segment, kind, hashes, counts)."""
    held: dict[int, list] = {0: [], 1: []}
    size = docs = tokens = 0

    least = np.array([-(-(s << 32) // segments) << 32 for s in range(segments)], _U)  # hash of each segment

    def pack():
        for kind, parts in held.items():
            if not parts:
                continue
            x = np.concatenate(parts)
            parts.clear()
            x.sort()
            at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            c = np.diff(np.r_[at, len(x)]).astype(np.uint32)
            h = x[at]
            del x, at
            ends = np.r_[np.searchsorted(h, least), len(h)].tolist()
            for i in range(0, segments, 16):
                rows = [(s, kind, h[ends[s] : ends[s + 1]].tobytes(), c[ends[s] : ends[s + 1]].tobytes()) for s in range(i, min(i + 16, segments)) if ends[s] < ends[s + 1]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["segment", "kind", "h", "c"])

    for b in batches:
        for at in range(0, b.num_rows, 500):
            rows = [token_hashes(t) for t in b.slice(at, 500).column(0).to_pylist()]
            if not rows:
                continue
            x = np.concatenate(rows)
            first = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
            held[0].append(x)
            held[1].append(pair_hashes(x, first))
            size += len(x)
            if size > PACKED:
                yield from pack()
                size = 0
    yield from pack()


def _sum_blobs(pdf):
    h = np.concatenate([np.frombuffer(x, _U) for x in pdf["h"]])
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["c"]])
    h, at = np.unique(h, return_inverse=True)
    return h, np.bincount(at, c).astype(np.int64)


def score(docs: DataFrame, train, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all rows by a model of the rows where ``train`` holds; ``held_out`` is passed on.

    Null and empty texts have one token, the end. Repeated rows are scored each, and each counts in the training. Without any training
    text all counts are 0, so each token of a text has the same probability, 0.1 / 0.1 = 1. Columns but the two named aren't read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"), held_out.alias("held_out"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = d.filter("train").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(4 * width, size // SEGMENT_BYTES)
    import pandas as pd

    def count(batches):
        return _count_batches(batches, segments)

    def total(key, pdf):
        h, c = _sum_blobs(pdf)
        return pd.DataFrame({"segment": [key[0]], "kind": [key[1]], "h": [h.tobytes()], "c": [c.astype("<i8").tobytes()],
                             "n": [len(h)], "sum": [int(c.sum())], "levels": [np.bincount(np.minimum(np.log2(c).astype(int), 31), minlength=32).tolist()]})

    blobs = d.filter("train").select("text").mapInArrow(count, "segment int, kind int, h binary, c binary")
    counted = saved(blobs.repartition(width, "segment", "kind").groupBy("segment", "kind").applyInPandas(
        total, "segment int, kind int, h binary, c binary, n long, sum long, levels array<long>"))

    stats = {(r.kind, r.level): (r.n, r.sum) for r in counted.select("kind", F.posexplode("levels").alias("level", "x"), F.when(F.col("level") == 0, F.col("sum")).alias("sum")).groupBy("kind", "level").agg(F.sum("x").alias("n"), F.sum("sum").alias("sum")).collect()}
    N = int(stats.get((0, 0), (0, 0))[1] or 0)
    V = sum(n for (k, _), (n, _) in stats.items() if k == 0)
    entries = sum((lv + 1) * n for (_, lv), (n, _) in stats.items())
    seg_bits = 1 << (max(1024, BITS * entries // segments) - 1).bit_length()

    def build(key, pdf):
        bits = np.zeros(seg_bits, bool)
        for kind, hb, cb in zip(pdf["kind"], pdf["h"], pdf["c"]):
            h, lv = np.frombuffer(hb, _U), np.log2(np.frombuffer(cb, "<i8")).astype(int)
            for level in range(int(lv.max(initial=-1)) + 1):
                for p in _positions(h[lv >= level], level + 1, seg_bits - 1):
                    bits[p] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    built = counted.select("segment", "kind", "h", "c").repartition(width, "segment").groupBy("segment").applyInPandas(build, "segment int, bits binary")
    built = saved(built).orderBy("segment")
    empty = b"\0" * (seg_bits // 8)

    def parts():
        at = 0
        for r in built.toLocalIterator():
            for k in range(at, r.segment):  # segments without an n-gram
                yield k, empty
            yield r.segment, r.bits
            at = r.segment + 1
        for k in range(at, segments):
            yield k, empty

    place = _publish(spark, parts(), seg_bits // 8)
    heavy_level = 31
    while heavy_level > 0 and sum(n for (k, lv), (n, _) in stats.items() if k == 0 and lv >= heavy_level - 1) <= HEAVY:
        heavy_level -= 1

    def unpack(least):
        def run(batches):
            for b in batches:
                for hb, cb in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    h, c = np.frombuffer(hb, np.int64), np.frombuffer(cb, "<i8")
                    on = c >= least
                    yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(c[on])], names=["h", "c"])
        return run

    words = counted.filter("kind = 0").select("h", "c")
    heavy = words.mapInArrow(unpack(1 << heavy_level), "h long, c long").toArrow()
    hh, hc = heavy.column(0).to_numpy().view(_U), heavy.column(1).to_numpy()
    order = np.argsort(hh)
    shared = spark.sparkContext.broadcast((hh[order].tobytes(), hc[order].tobytes()))  # at most HEAVY words
    del heavy
    rest = N + 0.1 * (V + 1)

    def run(batches):
        hb, cb = shared.value
        f = _mapped(*place, segments, seg_bits)
        keys, counts = np.frombuffer(hb, _U), np.frombuffer(cb, np.int64)
        at = int(np.searchsorted(keys, _U(END)))
        end = float(counts[at]) if at < len(keys) and keys[at] == END else float(high(f.levels(np.array([END], _U)))[0])
        task, row = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                toks = [token_hashes(t) for t in part.column(1).to_pylist()]
                size = np.array([len(t) for t in toks])
                x = np.concatenate(toks)
                first = np.r_[0, np.cumsum(size)[:-1]]
                u, inv = np.unique(x, return_inverse=True)
                spot = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
                is_heavy = keys[spot] == u if len(keys) else np.zeros(len(u), bool)
                exact = np.where(is_heavy, counts[spot], 0) if len(keys) else np.zeros(len(u), np.int64)
                lv = f.levels(u)
                own = np.where(is_heavy, exact, low(lv))[inv]
                most = np.where(is_heavy, exact, high(lv))[inv]
                before = np.r_[most[:1], most[:-1]]
                before[first] = end
                pair = np.minimum(low(f.levels(pair_hashes(x, first))), before)
                p = (pair + THETA * (own + 0.1) / rest) / (before + THETA)
                lm = np.add.reduceat(np.log10(p), first)
                known = is_heavy[inv]
                base = np.add.reduceat(np.where(known, np.log10((exact[inv] + 0.1) / rest), 0), first)
                rare = [t[~k].view(np.int64) for t, k in zip(np.split(x, first[1:]), np.split(known, first[1:]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(task + row + np.arange(len(toks))), part.column(0), part.column(2), pa.array(size.astype(np.int64)),
                    pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(base), pa.array(lm),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rare])].astype(np.int32)), pa.array(np.concatenate(rare)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
                row += len(toks)

    kind = d.schema["doc_id"].dataType.simpleString()
    scored = saved(d.select("doc_id", "text", "held_out").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"))
    counts = words.mapInArrow(unpack(1), "h long, c long").filter(F.col("c") < (1 << heavy_level))
    odd = scored.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").select(
        "row", F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(rest)).alias("base"), F.when(F.col("c") > 0, 1).otherwise(0).cast("long").alias("n_known"))
    odd = odd.groupBy("row").agg(F.sum("base").alias("more"), F.sum("n_known").alias("found"))
    return scored.drop("rare").join(odd, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(N).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
