"""Dense vectors: arithmetic, an index of unit vectors, exact neighbours, and a text embedder without a model file."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_lists, fnv1a, pieces, raw_spans, raw_tokens
from .ranking import top

TINY = 1e-12
QUERY_BYTES = 64 << 20  # the queries' matrix goes to the workers up to this size; more queries go in several such blocks


def dot(a, b) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v) -> Column:
    """To length 1; a vector of next to no length stays."""
    v = F.col(v) if isinstance(v, str) else v
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n <= TINY, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))), F.lit(0))


def cosine(a, b) -> Column:
    return F.when((norm(a) < TINY) | (norm(b) < TINY), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def fit_dimension(v, n: int) -> Column:
    """Cut or padded with zeros to n numbers."""
    return F.slice(F.concat(F.col(v).cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)


class VectorIndex:
    """(doc_id, v) of unit vectors of one dimension."""

    def __init__(self, vectors: DataFrame, dimension: int):
        self.dimension = dimension
        self.vectors = vectors.select("doc_id", fit_dimension("v", dimension).alias("v")).select("doc_id", normalize("v").alias("v"))

    def _with(self, vectors: DataFrame) -> "VectorIndex":
        out = VectorIndex.__new__(VectorIndex)
        out.dimension, out.vectors = self.dimension, vectors
        return out

    def upsert(self, vectors: DataFrame) -> "VectorIndex":
        new = VectorIndex(vectors, self.dimension).vectors
        return self._with(self.vectors.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new))

    def remove(self, ids: DataFrame) -> "VectorIndex":
        return self._with(self.vectors.join(ids.select("doc_id"), "doc_id", "left_anti"))

    def clear(self) -> "VectorIndex":
        return self._with(self.vectors.limit(0))

    def get(self, doc_id: int) -> DataFrame:
        return self.vectors.filter(F.col("doc_id") == doc_id)

    def size(self) -> int:
        return self.vectors.count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(self.vectors, queries.select("query_id", fit_dimension("q", self.dimension).alias("q")), k)


def _matrix(column, width: int | None = None) -> np.ndarray:
    rows = [np.asarray(x, float) if x is not None else np.zeros(0) for x in column]
    width = width if width is not None else max(map(len, rows), default=0)
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        m[i, : min(len(r), width)] = r[:width]
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.where(size < TINY, 0.0, m / np.where(size < TINY, 1.0, size))


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the exact k nearest by cosine of each query (query_id, q) among (doc_id, v), ties by doc_id.

    The queries go to the workers as one matrix of unit rows, in blocks of at most QUERY_BYTES. Each Arrow batch of vectors meets them in
    one product and passes on its own k best a query, so that what is shuffled is small and no pair is ever a row.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", "q").toArrow()
    ids = asked.column(0).to_pylist()
    q = _matrix(asked.column(1).to_pylist())
    kind = queries.schema["query_id"].dataType.simpleString()
    step = max(1, QUERY_BYTES // max(8, 8 * q.shape[1]))
    out = None
    for at in range(0, max(1, len(ids)), step):
        block = spark.sparkContext.broadcast((ids[at : at + step], q[at : at + step], asked.schema.field(0).type))
        part = vectors.select("doc_id", "v").mapInArrow(_nearest(block, k), f"query_id {kind}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, k)


def _nearest(block, k: int):
    def run(batches):
        names, q, kind = block.value
        for b in batches:
            if not b.num_rows or not names:
                continue
            v = _matrix(b.column(1).to_pylist(), q.shape[1])
            docs = np.array(b.column(0).to_pylist())
            s = np.clip(np.round(q @ v.T, 12), -1.0, 1.0)
            rows, cols = [], []
            for i in range(len(names)):
                order = np.lexsort((docs, -s[i]))[:k]
                rows.append(np.full(len(order), i))
                cols.append(order)
            r, c = np.concatenate(rows), np.concatenate(cols)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in r.tolist()], kind), pa.array(docs[c], b.column(0).type), pa.array(s[r, c])], names=["query_id", "doc_id", "score"])

    return run


#: Words that mean alike share an axis.
CONCEPTS = (
    "systems kernel compiler pointer ownership borrow rust memory concurrency thread bare-metal",
    "postings posting query retrieval bm25 index inverted engine search lexical vocabulary relevance snippet",
    "edges edge nodes node graph pagerank robots frontier url hyperlink web crawling crawl crawler",
    "complexity prefix sort hash tree heap trie algorithms algorithm",
    "node-failure fault-tolerant replica replication horizontal scalability scale cluster partition sharding distributed",
    "client server port socket packet protocols protocol http ip tcp networks network",
    "semantic embeddings embedding vector token transformer model learning deep neural intelligence artificial ai",
    "flight mach instability aeroelastic airflow wings wing airplane aircraft supersonic flutter aerodynamics aerodynamic",
    "puncture motor engine-repair mechanic tires tire maintenance repair drive vehicles vehicle automotive automobile cars car",
    "database deserialization serialize binary disk delta vbyte compression storage",
    "secret private cipher hash-function auth cryptography crypto secure security",
)
_AXIS = {w: k for k, line in enumerate(CONCEPTS) for w in line.split()}
_LIGHT = frozenset("as from it that this be were was are is by with of for to at on in if but or and the an a".split())
_AXES, _CONCEPT, _WORD, _GRAM, _FAINT = 12, 2.8, 1.5, 0.4, 0.15


def is_light_word(word: str) -> bool:
    """Whether the embedder gives the word little weight."""
    return word in _LIGHT


def concept_axis(word: str) -> int | None:
    return _AXIS.get(word)


@lru_cache(maxsize=50_000)
def _hash(letters: str) -> int:
    return fnv1a(letters.encode())


@lru_cache(maxsize=100_000)
def _word_parts(word: str, dimension: int) -> tuple[tuple[int, float], ...]:
    axes = min(_AXES, dimension // 2)
    room, weight = dimension - axes, _FAINT if is_light_word(word) else 1.0
    out = []
    axis = concept_axis(word)
    if axis is not None and axis < axes:
        out.append((axis, _CONCEPT * weight))

    def hashed(s: str, w: float) -> None:
        h = _hash(s) if len(s) == 3 else fnv1a(s.encode())
        out.append((axes + h % room, w if h >> 32 & 1 == 0 else -w))

    hashed(word, _WORD * weight)
    for i in range(len(word) - 2):
        hashed(word[i : i + 3], _GRAM * weight)
    return tuple(out)


def embed(text: str | None, dimension: int = 64) -> list[float]:
    """A unit vector of a text: concept axes, hashed words and hashed runs of three letters. No words, no length."""
    v = np.zeros(max(32, dimension), np.float32)
    for token, _, _ in raw_spans(text or ""):
        word = token.lower()
        if len(word.encode()) >= 2 and not word.startswith("http"):
            for i, x in _word_parts(word, len(v)):
                v[i] += np.float32(x)
    size = float(np.sqrt((v * v).sum()))
    return (v / np.float32(size) if size > TINY else v).tolist()


def embed_all(texts: pa.Array, dimension: int = 64) -> np.ndarray:
    """``embed`` of each text as a row: a word's parts are looked up once, and all are added in the order of the text."""
    room = max(32, dimension)
    out = np.zeros((len(texts), room), np.float32)
    for at, n in pieces(texts):
        found = [raw_tokens(t or "") for t in texts.slice(at, n).to_pylist()]
        words = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
        parts = [_token_parts(t, room) for t in words.dictionary.to_pylist()]
        sizes = np.array([len(p) for p in parts], np.int64)
        axis = np.array([i for p in parts for i, _ in p], np.int64)
        weight = np.array([x for p in parts for _, x in p], np.float32)
        code = words.indices.to_numpy()
        row = np.repeat(np.arange(at, at + n), [len(ws) for ws in found])
        many = sizes[code]
        part = np.arange(many.sum()) + np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(many) - many), many)
        np.add.at(out.reshape(-1), np.repeat(row, many) * room + axis[part], weight[part])
    for v in out:
        size = float(np.sqrt((v * v).sum()))
        if size > TINY:
            v /= np.float32(size)
    return out


def _token_parts(token: str, room: int) -> tuple[tuple[int, float], ...]:
    """What ``embed`` adds for a token."""
    word = token.lower()
    return _word_parts(word, room) if len(word.encode()) >= 2 and not word.startswith("http") else ()


def embed_udf(text, dimension: int = 64) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        rows = embed_all(texts, dimension)
        return as_lists(pa.array(rows.reshape(-1), pa.float32()), np.full(*rows.shape))

    return F.arrow_udf(run, "array<float>")(text)
