"""Best-fit packing of token sequences: local best fit, bins that nothing can join leave, underfull bins merge up a tree as items."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .unit_cache import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = PIECES + ", bin long, offset long, fill long, rank long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: its ids and end_id, cut every ``capacity`` ids. A null or empty text is its end id alone."""

    def run(batches):
        e = encoder(path, "word")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), e.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        x = ids[s : s + capacity]
                        rows.append((doc, k, s, len(x), zlib.crc32(x.tobytes())))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, largest items first, each into the fullest bin that takes it.

    Open bins are kept by what is left in them; one bit per value of "left" finds the least one that suffices.
    """
    out = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                some ^= 1 << left
        else:
            left, b, count = capacity, count, count + 1
        out[i] = b
        left -= size
        if left:
            open_bins[left].append(b)
            some |= 1 << left
    return out


def _merge(pdf: pd.DataFrame, base: int, capacity: int) -> pd.DataFrame:
    """One task's round: its bins are the items; pieces move with their bin. rank numbers the task's bins of equal fill."""
    pdf = pdf.sort_values(["bin", "offset"], kind="stable", ignore_index=True)
    first = np.flatnonzero(np.r_[True, np.diff(pdf["bin"].to_numpy()) != 0])
    fill = pdf["fill"].to_numpy()[first]
    to = best_fit(fill, capacity)
    order = np.argsort(to, kind="stable")
    ends = np.cumsum(fill[order])
    new = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
    start = np.empty(len(fill), np.int64)
    start[order] = ends - fill[order] - np.repeat(ends[new] - fill[order][new], np.diff(np.r_[new, len(fill)]))
    total = np.bincount(to, fill).astype(np.int64)
    item = np.repeat(np.arange(len(fill)), np.diff(np.r_[first, len(pdf)]))
    pdf["offset"] = pdf["offset"].to_numpy() + start[item]
    pdf["bin"] = base + to[item]
    pdf["fill"] = total[to[item]]
    by = np.argsort(total, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(total[by]) != 0])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    pdf["rank"] = rank[to[item]]
    return pdf


def _round(base: int, capacity: int):
    def run(key, pdf):
        return _merge(pdf.drop(columns="task"), base | int(key[0]) << 32, capacity)

    return run


def wanted(bins: dict[int, int], capacity: int) -> list[int]:
    """For each fill from 1 to ``capacity``, how many bins of that fill merges could use, given the number of open bins by fill.

    Of the bins in one merge at most one is more than half full, so a fuller fill needs no more bins than there are bins of at most
    a half that fit in beside it; bins of equal fill are alike. Bins of at most a half are all wanted.
    """
    half = capacity // 2
    upto = np.cumsum([bins.get(f, 0) for f in range(half + 1)])
    return [bins.get(f, 0) if f <= half else int(upto[capacity - f]) for f in range(1, capacity + 1)]


def pack(items: DataFrame, capacity: int = 2048, per_task: int = 50_000) -> DataFrame:
    """items: PIECES, lengths 1 to capacity. Adds sequence_id and offset.

    Every round spreads the open bins over tasks of about ``per_task`` bins by a hash of their number and packs each task's bins by best
    fit. Then bins leave that no merge can use: those fuller than a half, beyond as many of their fill as there are bins, in all tasks,
    that fit in beside one (``wanted``). So no merge of two open bins is ruled out, and as best fit leaves a task with at most one bin
    that is at most half full, few stay. The next round has at most half the tasks, and the last one merges all that is left. No piece
    is left out. An empty table gives an empty one.
    """
    rest = saved(items).select("*", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill"), F.lit(0).cast("long").alias("rank"))
    bins = rest.count()
    tasks = max(1, -(-bins // per_task))
    finished, level = [], 1
    while True:
        at = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(tasks)).cast("int")
        out = saved(rest.withColumn("task", at).repartition(max(1, min(tasks, 4096)), "task").groupBy("task").applyInPandas(_round(level << 56, capacity), STATE))
        if tasks == 1:
            finished.append(out)
            break
        bins = {r["fill"]: r["count"] for r in out.filter("offset = 0").groupBy("fill").count().collect()}  # at most ``capacity`` rows
        stays = F.col("rank") < F.expr(f"get(array({', '.join(f'{n}L' for n in wanted(bins, capacity))}), int(fill) - 1)")
        finished.append(out.filter(~stays))
        rest = out.filter(stays)
        left, pieces_left = rest.agg(F.count(F.when(F.col("offset") == 0, 1)), F.count("*")).first()
        if not left:
            break
        tasks = max(1, min(-(-tasks // 2), max(-(-left // per_task), -(-pieces_left // (16 * per_task)))))
        level += 1
    done = finished[0]
    for x in finished[1:]:
        done = done.unionByName(x)
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, **kw) -> DataFrame:
    """Documents to packed pieces. Repeated rows are packed each; a null doc_id stays null; other columns are not read."""
    return pack(pieces(docs, path, capacity), capacity, **kw)
