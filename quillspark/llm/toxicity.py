"""Toxicity by multiple-instance learning: sentences get scores, a text's score is their noisy-or, labels are known for texts only.

The weights are those of words and word beginnings; they are learnt by gradient steps on the likelihood of the texts' labels under
1 - prod(1 - p(sentence)). The same sentence scores then say which sentences offend.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_POSITIVE, MAX_NEGATIVE = 2000, 4000  # the usual bounds of the sample of labelled texts that the weights are fitted on
PREDICT = 0.3  # the score from which a text counts as toxic
LEAST_TEXTS = 3  # a feature counts if it is in so many texts of the sample
# These and the features were chosen by cross-validation within the learning rows of sf0.1 (crc32 mod 4 of 0, 1, 3, each held out once)
STEPS, RATE, BIAS = 80, 1.0, -10.0
SPARSE = 0.3  # the L1 penalty, in labelled texts: what fewer texts speak for gets no weight
_END = re.compile(r"[.!?\n]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(token: str) -> tuple[str, ...]:
    """The word between its first and last letter, and its first four and five letters."""
    w = _EDGE.sub("", token).lower()
    return (w, *("^" + w[:n] for n in (4, 5) if len(w) > n)) if w else ()


def fit(texts: list[str], labels: list[int]) -> tuple[dict[str, float], float]:
    """The weights of features and the bias."""
    index: dict[str, int] = {}
    seen: dict[str, int] = {}
    bags = []
    for t in texts:
        bag = [{f for w in s.split() for f in features(w)} for s in _END.split(t)]
        bags.append([b for b in bag if b])
        for f in set().union(*bag):
            seen[f] = seen.get(f, 0) + 1
    row, col, doc, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for b in bag:
            ids = [index.setdefault(f, len(index)) for f in b if seen[f] >= LEAST_TEXTS]
            row += [n] * len(ids)
            col += ids
            doc.append(d)
            n += 1
    row_, col_, doc_, y = np.array(row, np.int32), np.array(col, np.int32), np.array(doc, np.int32), np.array(labels, float)
    w, b = np.zeros(len(index)), BIAS
    gw, gb = np.full(len(index), 1e-6), 1e-6
    for _ in range(STEPS if n else 0):
        z = b + np.bincount(row_, w[col_], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(-np.bincount(doc_, np.logaddexp(0, z), len(y)))
        hit = np.maximum(1 - clean, 1e-9)
        g = np.where(y > 0, -clean / hit, 1.0)
        gz = g[doc_] * p
        dw, db = np.bincount(col_, gz[row_], len(w)), gz.sum()
        gw += dw**2
        gb += db**2
        step = RATE / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSE, 0)
        b -= RATE * db / np.sqrt(gb)
    names = list(index)
    return {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(b)


class Scorer:
    MAX_TOKENS = 300_000

    def __init__(self, names: tuple, values: tuple, bias: float):
        self.weight, self.bias, self.cache = dict(zip(names, values)), bias, {}

    def _token(self, t: str) -> float:
        x = sum(self.weight.get(f, 0.0) for f in features(t))
        if len(self.cache) > self.MAX_TOKENS:
            self.cache.clear()
        self.cache[t] = x
        return x

    def sentence(self, s: str) -> float:
        """The log-odds of a sentence; a token that comes twice counts once."""
        get = self.cache.get
        words = dict.fromkeys(s.split())
        return self.bias + sum(x if (x := get(w)) is not None else self._token(w) for w in words)

    def text(self, t: str):
        """The score, and (start, end, score) of each sentence in code points."""
        at, spans = 0, []
        for m in [*_END.finditer(t), None]:
            end = m.start() if m else len(t)
            if t[at:end].strip():
                z = self.sentence(t[at:end])
                spans.append((at, end, z))
            at = m.end() if m else end
        z = np.array([x[2] for x in spans])
        score = -np.expm1(-np.logaddexp(0, z).sum()) if len(z) else 0.0
        return float(score), spans


@lru_cache(maxsize=2)
def _scorer(names: tuple, values: tuple, bias: float) -> Scorer:
    return Scorer(names, values, bias)


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE):
    """Fits on at most max_positive and max_negative labelled rows where ``learn`` holds, those of least hash of doc_id; in one task.

    Rows without a label or a text teach nothing; without any row of one kind no feature gets a weight.
    """
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & learn)
    order = F.xxhash64(F.col("doc_id"))
    ids = named.filter("toxic = 1").orderBy(order, "doc_id").limit(max_positive).unionByName(named.filter("toxic <> 1").orderBy(order, "doc_id").limit(max_negative))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic").withColumn("one", F.lit(1))

    def run(pdf):
        pdf = pdf.sort_values(["text", "toxic"], kind="stable")
        w, b = fit([t or "" for t in pdf["text"]], (pdf["toxic"] == 1).astype(int).tolist())
        return pd.DataFrame({"name": ["", *w], "value": [b, *w.values()]})

    rows = sample.groupBy("one").applyInPandas(run, "name string, value double").collect()
    bias = next((r.value for r in rows if r.name == ""), BIAS)
    rows = sorted((r.name, r.value) for r in rows if r.name != "")
    return tuple(r[0] for r in rows), tuple(r[1] for r in rows), bias


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", offends: float = 0.5, predict: float = PREDICT) -> DataFrame:
    """(doc_id, score, n_sentences, offending array of start, end, score) per row.

    Offending are the sentences whose own probability is ``offends`` or more; a text that scores ``predict`` or more always has one at
    least, the sentence with the greatest part in its noisy-or. Null and empty texts have no sentence and score 0. Repeated rows are scored each; whole texts are read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(model)  # at most the features of the bounded sample
    least = float(np.log(offends / (1 - offends)))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        s = _scorer(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [s.text(t or "") for t in part.column(1).to_pylist()]
                bad = [[{"start": a, "end": e, "score": float(1 / (1 + np.exp(-z)))} for a, e, z in spans if z >= min(least, top if total >= predict else least)]
                       for total, spans in rows for top in [max((x[2] for x in spans), default=0.0)]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows]), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(bad, span)], names=["doc_id", "score", "n_sentences", "offending"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>")
