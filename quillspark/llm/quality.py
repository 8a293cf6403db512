"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, words_of

SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this from at or an not have which "
    "le la les de des du et en est que qui dans pour par sur une un au avec ce pas "
    "der die das und den von zu ist mit auf für ein eine im dem nicht sich "
    "el los las y por con para del se una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric and the closed range in which it may lie; None leaves an end open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Metrics are the fields of ``metrics``; ratios of an empty text are 0.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.4),
    Rule("repeat_ratio", most=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared as 64-bit hashes within one text; only texts with a repeat are sorted."""
    windows = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    )

    def by_sort(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        same = lambda e, o: F.coalesce(e["v"] == o["v"], F.lit(False))
        return let(order, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, k: same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1))), lambda e: e["i"])))

    def by_lookup(h: Column, repeated: Column) -> Column:
        return F.filter(F.transform(h, lambda v, i: F.when(F.array_contains(repeated, v), i)), lambda i: i.isNotNull())

    def covered(h: Column) -> Column:
        repeated = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda v, k: v == F.get(s, k + 1))))
        starts = let(repeated, lambda r: F.when(F.size(r) <= 16, by_lookup(h, r)).otherwise(by_sort(h)))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)), F.lit(0), lambda a, b: a + b))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def metrics(text: Column) -> Column:
    """One struct of all counts and ratios of a text."""
    text = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return let(let(words_of(text), counts), lambda c: F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), c["n_stop"].alias("n_stop"),
        ratio(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
        ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
        ratio(c["n_stop"], c["n_words"]).alias("stop_ratio"),
        ratio(c["lines"]["dup"], c["lines"]["n"]).alias("dup_line_ratio"),
        ratio(c["n_repeat_words"], c["n_words"]).alias("repeat_ratio"),
    ))


def verdict(m: Column, rules=RULES) -> Column:
    """The rule table as one boolean expression over the struct of ``metrics``."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (m[r.metric] >= F.lit(r.least))
        if r.most is not None:
            ok = ok & (m[r.metric] <= F.lit(r.most))
    return ok


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: id, the metrics, base_failed, kept.

    Null and empty texts have no words, so they fail; repeated rows are judged alike; an empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    m = F.col("m")
    return docs.select(F.col(id_col).alias("doc_id"), metrics(F.col(text_col)).alias("m")).select(
        "doc_id", "m.*", base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with the columns of the input."""
    return docs.filter(let(metrics(F.col(text_col)), lambda m: ~base_failed(m) & verdict(m, rules)))
