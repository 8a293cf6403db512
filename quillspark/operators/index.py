"""The positional inverted index as tables.

An ``Index`` has postings (term, doc_id, tf, positions), lengths (doc_id, len), field postings (field, term, doc_id, tf) and field
lengths (field, doc_id, len). Terms are stems unless it is built without. All of a document's tokens are in one row before they are
grouped, so counting merges them before the shuffle: what moves is one row for each term of a document.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import as_blobs, as_lists, found, n_tokens, pack_lists, pack_udf, positions_udf, stems_of, terms, terms_of

FIELDS = ("title", "body", "anchor")
_ALIASES = {"title": "title", "body": "body", "text": "body", "content": "body", "anchor": "anchor", "links": "anchor", "inlink": "anchor"}
POSTINGS = "term string, doc_id long, tf long, positions array<int>"
LENGTHS = "doc_id long, len long"
FIELD_POSTINGS = "field string, term string, doc_id long, tf long"
FIELD_LENGTHS = "field string, doc_id long, len long"


def field_of(name: str) -> str | None:
    """The field a name stands for, in any case; None for others."""
    return _ALIASES.get(name.lower())


def analyzed(text: Column, stemmed: bool = True) -> Column:
    return stems_of(terms(text)) if stemmed else terms(text)


def term_rows(docs: DataFrame, text: str = "text", stemmed: bool = True) -> DataFrame:
    """(doc_id, pos, term)."""
    return docs.select("doc_id", analyzed(F.col(text), stemmed).alias("ts")).select("doc_id", F.posexplode("ts").alias("pos", "term"))


def postings(docs: DataFrame, text: str = "text", stemmed: bool = True) -> DataFrame:
    return term_rows(docs, text, stemmed).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.size(terms(F.col(text))).cast("long").alias("len"))


def _first_line() -> tuple[Column, Column]:
    """The first line of the text and what comes after it."""
    first = F.substring_index("text", "\n", 1)
    return first, F.substring(F.col("text"), F.length(first) + 2, F.length("text"))


def fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, text): the first line as title, the rest as body, the source as anchor text; empty fields are left out."""
    first, rest = _first_line()
    return split_fields(docs.select("doc_id", first.alias("title"), rest.alias("body"), F.col("source").alias("anchor")))


def split_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, text) of (doc_id, title, body, anchor); empty fields are left out."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in FIELDS])
    return docs.select("doc_id", F.inline(parts)).filter(F.length(F.trim("text")) > 0)


def field_counts(rows: DataFrame, stemmed: bool = True) -> DataFrame:
    """(field, term, doc_id, tf) of (doc_id, field, text)."""
    return rows.select("doc_id", "field", F.explode(analyzed(F.col("text"), stemmed)).alias("term")).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))


def field_lengths(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "field", F.size(terms(F.col("text"))).cast("long").alias("len"))


BLOCKS = "part int, term string, n int, total long, doc_id array<{}>, tf array<int>, title array<int>, body array<int>, anchor array<int>, positions binary"
SLICE_TOKENS = 1 << 20  # what a task counts at once, and so what a block is of; a longer text alone
PART_ROWS = 1 << 21  # postings of a file, about
BOUND_DOCS = 2000  # texts by whose terms the files' bounds are laid


def blocks(docs: DataFrame, stemmed: bool = True, bounds: list[str] | None = None) -> DataFrame:
    """One pass over (doc_id, text, source): each term's documents in some of the texts as one row of arrays, and these texts' lengths.

    A term's row has the number of documents and tokens, then by document how often the text has the term, and of that its first line, and
    the packed positions; ``fields`` splits texts in the same way. The sources' terms are rows of their own with ``anchor``, and n is 0. A row
    without a term has the lengths of texts and of fields, null for a field that a document hasn't. ``part`` is the stretch between the
    ``bounds`` that the term is in; the rows of a term that is several bounds are spread over its stretches.
    """
    first, rest = _first_line()
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    source = F.when(has(F.col("source")), found(F.col("source"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", found(F.col("text")).alias("ts"), n_tokens(first).alias("first"), has(first).alias("title"), has(rest).alias("body"), source.alias("anchors"), has(F.col("source")).alias("anchor"))
    return rows.mapInArrow(_blocks_of(stemmed, bounds or []), BLOCKS.format(docs.schema["doc_id"].dataType.simpleString()))


def _blocks_of(stemmed: bool, bounds: list[str]):
    def run(batches):
        k = 0
        for b in batches:
            ends, at = np.cumsum(_sizes(b.column("ts")) + _sizes(b.column("anchors"))), 0
            while at < b.num_rows:
                had = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, had + SLICE_TOKENS, "right")))
                yield from _slice_blocks(b.slice(at, to - at), stemmed, bounds, k)
                at, k = to, k + 1

    return run


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _slice_blocks(b: pa.RecordBatch, stemmed: bool, bounds: list[str], k: int):
    ids, first = b.column("doc_id"), b.column("first").to_numpy()
    sizes, anchors = _sizes(b.column("ts")), _sizes(b.column("anchors"))
    ints = lambda x, there=None: pa.array(x, pa.int32(), mask=None if there is None else ~b.column(there).to_numpy(zero_copy_only=False))
    yield _batch([0], pa.nulls(1, pa.string()), [0], [0], [0, len(ids)], ids, ints(sizes), ints(first, "title"), ints(sizes - first, "body"), ints(anchors, "anchor"))
    for column, n in (("ts", sizes), ("anchors", anchors)):
        if not n.sum():
            continue
        terms, low, more, code = _coded(b.column(column).flatten(), stemmed, bounds)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        code, doc, starts, pos = _grouped(code, np.repeat(np.arange(len(n)), n), pos)
        tf = np.diff(np.append(starts, len(pos)))
        at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        code, ends = code[at], np.append(at, len(code))
        part, term, doc_id = low[code] + k % (more[code] + 1), terms.take(pa.array(code)), ids.take(pa.array(doc))
        if column == "anchors":
            yield _batch(part, term, np.zeros_like(part), np.zeros_like(part), ends, doc_id, anchor=ints(tf))
        else:
            title = np.add.reduceat(pos < np.repeat(first[doc], tf), starts, dtype=np.int64)
            data, sizes = pack_lists(pos, tf)
            yield _batch(part, term, np.diff(ends), np.add.reduceat(tf, at), ends, doc_id, ints(tf), ints(title), positions=as_blobs(data, np.add.reduceat(sizes, at)))


def _batch(part, term, n, total, ends, doc_id, tf=None, title=None, body=None, anchor=None, positions=None) -> pa.RecordBatch:
    lists = lambda x: as_lists(x, np.diff(ends)) if x is not None else pa.nulls(len(term), pa.list_(pa.int32()))
    columns = [pa.array(part, pa.int32()), term, pa.array(n, pa.int32()), pa.array(total, pa.int64()), *map(lists, (doc_id, tf, title, body, anchor)), positions if positions is not None else pa.nulls(len(term), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "term", "n", "total", "doc_id", "tf", "title", "body", "anchor", "positions"])


def _coded(tokens: pa.Array, stemmed: bool, bounds: list[str]):
    """The distinct terms, the first part of each and how many more it is spread over, and each token's term by number."""
    d = tokens.dictionary_encode()
    known: dict[str, int] = {}
    of = np.array([known.setdefault(t, len(known)) for t in terms_of(d.dictionary.to_pylist(), stemmed)], np.int64)
    low = np.array([bisect_left(bounds, t) for t in known], np.int64)
    more = np.array([bisect_right(bounds, t, k) - k if k < len(bounds) and bounds[k] == t else 0 for t, k in zip(known, low.tolist())], np.int64)
    return pa.array(list(known), pa.string()), low, more, of[d.indices.to_numpy()]


def _grouped(code: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Term and document of each pair of them, where its positions start, and all positions, in the order of term, document, position."""
    bits = [int(x.max()).bit_length() for x in (code, doc, pos)]
    if sum(bits) < 63:
        key = np.sort(((code << bits[1] | doc) << bits[2]) | pos)
        pos, key = key & ((1 << bits[2]) - 1), key >> bits[2]
        code, doc = key >> bits[1], key & ((1 << bits[1]) - 1)
    else:
        order = np.lexsort((pos, doc, code))
        code, doc, pos = code[order], doc[order], pos[order]
    starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
    return code[starts], doc[starts], starts, pos


def term_bounds(docs: DataFrame, n_docs: int, stemmed: bool = True) -> list[str]:
    """Terms that cut the postings into parts of about PART_ROWS; a very frequent term may be several bounds.

    They are laid by the terms of some texts, as Spark's own ranges are; they only balance the files, each row is in one whatever they are.
    """
    share = min(1.0, BOUND_DOCS / max(1, n_docs))
    some = blocks(docs if share == 1 else docs.sample(share, 7), stemmed).filter("term IS NOT NULL")
    seen = sorted((r.term, r.rows) for r in some.groupBy("term").agg(F.sum(F.size("doc_id")).alias("rows")).collect())
    if not seen:
        return []
    ends = np.cumsum([n for _, n in seen])
    parts = int(np.ceil(ends[-1] / share / PART_ROWS))
    return [seen[k][0] for k in np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)]


def term_table(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """The rows of ``blocks`` to be stored: files by ranges of terms, sorted by term."""
    ids = docs.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(1)).alias("most")).first()
    bounds = term_bounds(docs, ids.n, stemmed)
    rows = blocks(docs, stemmed, bounds)
    if ids.most > 1:
        rows = rows.filter("term IS NULL").unionByName(_merged(rows.filter("term IS NOT NULL")), allowMissingColumns=True)
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("term").drop("part")


def _zipped(*names: str) -> Column:
    """A row for each document of a block; an array that isn't there gives nulls."""
    part = lambda c: positions_udf("tf", c) if c == "positions" else F.col(c)
    return F.inline(F.arrays_zip(*[F.coalesce(part(c), F.array()).alias(c) for c in names]))


def _merged(rows: DataFrame) -> DataFrame:
    """The same where several texts have one id: what they have of a term becomes one posting, in a block of its own."""
    flat = rows.select("part", "term", _zipped("doc_id", "tf", "title", "anchor", "positions"))
    sums = [F.sum(c).cast("int").alias(c) for c in ("tf", "title", "anchor")]
    one = flat.groupBy("term", "doc_id").agg(F.min("part").alias("part"), *sums, F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    arrays = [F.when(F.col("tf").isNotNull(), c).alias(n) for n, c in (("tf", F.array("tf")), ("title", F.array("title")), ("positions", pack_udf("positions")))]
    return one.select("part", "term", F.col("tf").isNotNull().cast("int").alias("n"), F.coalesce("tf", F.lit(0)).cast("long").alias("total"), F.array("doc_id").alias("doc_id"), *arrays, F.when(F.col("anchor").isNotNull(), F.array("anchor")).alias("anchor"))


def deltas(rows: DataFrame) -> DataFrame:
    """Gaps between the ascending doc_ids of each term, the first as it is."""
    w = Window.partitionBy("term").orderBy("doc_id")
    return rows.select("term", "doc_id", (F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.lit(0))).alias("gap"))


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    field_postings: DataFrame | None = None
    field_lengths: DataFrame | None = None
    docs: DataFrame | None = field(default=None)
    stemmed: bool = True

    @classmethod
    def build(cls, docs: DataFrame, with_fields: DataFrame | None = None, stemmed: bool = True) -> "Index":
        """Of (doc_id, text), and of (doc_id, field, text) for the fields."""
        f = with_fields
        return cls(postings(docs, stemmed=stemmed), lengths(docs), field_counts(f, stemmed) if f is not None else None, field_lengths(f) if f is not None else None, docs, stemmed)

    @classmethod
    def stored(cls, table: DataFrame, docs: DataFrame | None = None, stemmed: bool = True) -> "Index":
        """Over a written ``term_table``; all tables are views of it that read no more than their columns and terms."""
        words, whole = table.filter("term IS NOT NULL"), table.filter("term IS NULL")
        text = words.filter("n > 0")
        count = lambda c: F.col(c).cast("long")
        by_field = lambda body: F.inline(F.array(*[F.struct(F.lit(n).alias("field"), (body if n == "body" else F.col(n)).cast("long").alias("n")) for n in FIELDS]))
        out = cls(
            text.select("term", _zipped("doc_id", "tf", "positions")).select("term", "doc_id", count("tf").alias("tf"), "positions"),
            whole.select(_zipped("doc_id", "tf")).select("doc_id", count("tf").alias("len")),
            words.select("term", _zipped("doc_id", "tf", "title", "anchor")).select("term", "doc_id", by_field(F.col("tf") - F.col("title"))).filter("n > 0").select("field", "term", "doc_id", F.col("n").alias("tf")),
            whole.select(_zipped("doc_id", "title", "body", "anchor")).select("doc_id", by_field(F.col("body"))).filter("n IS NOT NULL").select("field", "doc_id", F.col("n").alias("len")),
            docs, stemmed)
        out.__dict__["frequencies"] = text.select("term", _zipped("doc_id", "tf")).select("term", "doc_id", count("tf").alias("tf"))
        out.__dict__["vocabulary"] = text.groupBy("term").agg(F.sum("total").alias("tf"), F.sum("n").alias("df"))
        return out

    @classmethod
    def empty(cls, spark: SparkSession) -> "Index":
        return cls(*[spark.createDataFrame([], s) for s in (POSTINGS, LENGTHS, FIELD_POSTINGS, FIELD_LENGTHS)])

    @cached_property
    def frequencies(self) -> DataFrame:
        """(term, doc_id, tf): the postings without positions."""
        return self.postings.select("term", "doc_id", "tf")

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(term, tf, df)."""
        return self.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))

    @cached_property
    def stats(self) -> DataFrame:
        """One row: n documents, their average length (0 without any)."""
        return self.lengths.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg"))

    @cached_property
    def field_stats(self) -> DataFrame:
        """(field, n_docs, avg_len) over the documents that have the field."""
        return self.field_lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))

    def doc_ids(self) -> DataFrame:
        return self.lengths.select("doc_id")

    def get_postings(self, term: str) -> DataFrame:
        return self.postings.filter(F.col("term") == term)

    def document_frequency(self) -> DataFrame:
        """(term, df): documents that have the term in any field."""
        return self.field_postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))

    def rows(self) -> DataFrame:
        """(doc_id, pos, term)."""
        return self.postings.select("doc_id", F.explode("positions").alias("pos"), "term")

    def add(self, docs: DataFrame) -> "Index":
        """With the new documents of (doc_id, text); ids that are here already are for ``append``."""
        return Index(self.postings.unionByName(postings(docs, stemmed=self.stemmed)), self.lengths.unionByName(lengths(docs)), self.field_postings, self.field_lengths, None, self.stemmed)

    def append(self, docs: DataFrame) -> "Index":
        """With more text of documents, one row a document: positions go on where a document's text ended; new ids are added."""
        base = self.lengths.withColumnRenamed("len", "_base")
        new = postings(docs, stemmed=self.stemmed).join(base, "doc_id", "left").select(
            "term", "doc_id", "tf", F.transform("positions", lambda p: p + F.coalesce(F.col("_base"), F.lit(0)).cast("int")).alias("positions"))
        both = self.postings.unionByName(new).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        sizes = self.lengths.unionByName(lengths(docs)).groupBy("doc_id").agg(F.sum("len").alias("len"))
        return Index(both, sizes, self.field_postings, self.field_lengths, None, self.stemmed)

    def add_field(self, name: str, rows: DataFrame) -> "Index":
        """With the texts of (doc_id, text) in one field; blank ones change nothing, counts of a field a document has already add up."""
        new = rows.select("doc_id", F.lit(field_of(name)).alias("field"), "text").filter(F.length(F.trim("text")) > 0)
        counted = self.field_postings.unionByName(field_counts(new, self.stemmed)).groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"))
        sizes = self.field_lengths.unionByName(field_lengths(new).select("field", "doc_id", "len")).groupBy("field", "doc_id").agg(F.sum("len").alias("len"))
        return Index(self.postings, self.lengths, counted, sizes, self.docs, self.stemmed)

    def append_anchors(self, links: DataFrame) -> "Index":
        """With the anchor texts of (doc_id, text), joined by spaces for each target."""
        joined = links.groupBy("doc_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
        return self.add_field("anchor", joined)
