"""Completion and spelling from counts of words and phrases: (term, tf, df)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TOKEN, osa_udf, tokens

COUNTS = "term string, tf long, df long"


PIECE_TOKENS = 1 << 18  # of texts whose phrases a worker makes at once; a longer text alone


def usable(token: str) -> bool:
    """Not a URL, not all digits, two bytes at least."""
    return not token.startswith("http") and not (token.isascii() and token.isdigit()) and len(token.encode()) >= 2


def _counted_grams(most: int):
    """Batches of one column, sentences of words by text, to (term, n): the words and phrases of some texts and how often they are there."""
    def run(batches):
        for b in batches:
            at, ends = 0, _token_ends(b.column(0))
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_TOKENS, "right")))
                yield from _phrases(b.column(0).slice(at, to - at).flatten(), most)
                at = to

    return run


def _token_ends(texts: pa.Array) -> np.ndarray:
    """The number of words up to the end of each text."""
    outer, words = texts.offsets.to_numpy(), np.append(0, np.cumsum(np.diff(texts.values.offsets.to_numpy())))
    return words[outer[1:]] - words[outer[0]]


def _phrases(sentences: pa.Array, most: int):
    sizes, words = np.diff(sentences.offsets.to_numpy()), sentences.flatten().dictionary_encode()
    given = words.dictionary.to_pylist()
    good = np.array([usable(t) for t in given], bool)[words.indices.to_numpy()]
    lower = pa.array([t.lower() for t in given], pa.string()).take(words.indices)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    for n in range(1, most + 1):
        last = len(good) - n + 1
        if last <= 0:
            return
        fits = sentence[n - 1 :] == sentence[:last]
        for k in range(n):
            fits &= good[k : k + last]
        at = np.flatnonzero(fits)
        parts = [lower.take(pa.array(at + k)) for k in range(n)]
        found = (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]).value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "n"])


def sentences(text: Column) -> Column:
    """The tokens of each stretch of a text between ``.``, ``!``, ``?`` and line ends that stand outside of tokens."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"({TOKEN})|[.!?\\n]", "\u0001$1\u0002")  # a mark of its own has nothing between
    url = "^(?:https?|ftp)://"
    cut = lambda t: F.when(t.rlike(url), F.regexp_replace(t, "[.,?!]+$", "")).otherwise(t)
    return F.transform(F.split(marked, "\u0001\u0002"), lambda p: F.transform(F.regexp_extract_all(p, F.lit("\u0001([^\u0002]*)\u0002"), F.lit(1)), cut))


def grams(texts: DataFrame, most: int = 3, weight: int = 1, boundaries: bool = True) -> DataFrame:
    """(term, tf, df) of the words and of 2- to ``most``-word phrases of (text); phrases stay within a sentence unless told else."""
    parts = sentences(F.col("text")) if boundaries else F.array(tokens(F.coalesce(F.col("text"), F.lit(""))))
    found = texts.select(parts.alias("w")).mapInArrow(_counted_grams(most), "term string, n long")
    return found.groupBy("term").agg((F.sum("n") * weight).alias("tf"), F.sum("n").alias("df"))


def merge(*counts: DataFrame) -> DataFrame:
    """Counts added up; terms in lower case without white space at their ends."""
    out = counts[0].select("term", "tf", "df")
    for c in counts[1:]:
        out = out.unionByName(c.select("term", "tf", "df"))
    return out.select(F.lower(F.trim("term")).alias("term"), "tf", "df").filter("term <> ''").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def from_corpus(entries: DataFrame) -> DataFrame:
    """Of (title, body): titles count three times with phrases up to four words across marks, bodies once up to three words."""
    return merge(grams(entries.select(F.col("title").alias("text")), 4, 3, boundaries=False), grams(entries.select(F.col("body").alias("text")), 3))


def record_queries(queries: DataFrame) -> DataFrame:
    """Of (text): each asked query counts five; commands and single bytes don't."""
    q = F.lower(F.trim("text"))
    good = queries.select(q.alias("term")).filter((F.octet_length("term") >= 2) & ~F.col("term").startswith(":"))
    return good.groupBy("term").agg((F.count("*") * 5).alias("tf"), F.count("*").alias("df"))


def suggest(counts: DataFrame, prefix: str, k: int) -> DataFrame:
    """The k terms of most tf, then df, then first in order, that begin so."""
    p = prefix.strip().lower()
    return counts.filter(F.col("term").startswith(p)).orderBy(F.desc("tf"), F.desc("df"), "term").limit(max(0, k))


def find_by_prefix(counts: DataFrame, prefix: str) -> DataFrame:
    return counts.filter(F.col("term").startswith(prefix.strip().lower())).orderBy("term")


def contains(counts: DataFrame, term: str) -> DataFrame:
    """The row of one term, none if it isn't there."""
    return counts.filter(F.col("term") == term.strip().lower())


def spell(vocabulary: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion, distance) of (word): itself at distance 0, else the term of least distance, same first letter, most tf, first in order.

    ``words`` is small: it is broadcast after a look at its size. Pairs whose lengths or plain edit distance (a swap counts two there)
    rule them out never reach the distance function.
    """
    asked = words.select(F.lower("word").alias("word")).distinct()
    if asked.count() <= 100_000:
        asked = F.broadcast(asked)
    pairs = vocabulary.join(asked, F.abs(F.octet_length("term") - F.octet_length("word")) <= most)
    near = pairs.filter(F.levenshtein("term", "word", 2 * most) >= 0).withColumn("distance", osa_udf("word", "term")).filter(F.col("distance") <= most)
    first = (F.substring("word", 1, 1) == F.substring("term", 1, 1)).cast("int")
    best = F.min(F.struct("distance", (-first).alias("f"), (-F.col("tf")).alias("t"), "term")).alias("b")
    return near.groupBy("word").agg(best).select("word", F.col("b.term").alias("suggestion"), F.col("b.distance").alias("distance"))


def spell_queries(vocabulary: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, corrected) of (query_id, text): words that aren't known are replaced by what ``spell`` finds; null if nothing was."""
    words = queries.select("query_id", F.posexplode(F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != "")).alias("at", "raw")).withColumn("word", F.lower("raw"))
    known = spell(vocabulary, words.select("word"), most)
    fixed = words.join(known, "word", "left").select("query_id", "at", F.when(F.col("distance") > 0, F.col("suggestion")).otherwise(F.col("raw")).alias("w"), (F.coalesce("distance", F.lit(0)) > 0).alias("new"))
    done = fixed.groupBy("query_id").agg(F.bool_or("new").alias("new"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda e: e["w"]), " ").alias("text"))
    return queries.select("query_id").join(done, "query_id", "left").select("query_id", F.when(F.col("new"), F.col("text")).alias("corrected"))


def ranked(counts: DataFrame, prefixes: DataFrame, k: int) -> DataFrame:
    """``suggest`` for many (prefix) at once: (prefix, term, tf, df, rank)."""
    pairs = counts.join(F.broadcast(prefixes), F.col("term").startswith(F.col("prefix")))
    w = Window.partitionBy("prefix").orderBy(F.desc("tf"), F.desc("df"), "term")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
