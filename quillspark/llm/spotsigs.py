"""SpotSigs: a document's signatures are chains of content words after common-word anchors; their sets are compared by pruned Jaccard.

An anchor is one of ANCHORS, or the start of the text, so that every text with a content word has a signature. A chain is the
content word behind the anchor and the next one, other anchors skipped. A text of anchors only has the hash of its words; a text
without words has the empty set. Signatures are 32-bit hashes; the fingerprint is the sorted set in hexadecimal.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, let, saved

ANCHORS = "a an the is was of to in that le la les des une un que der die das ein eine und el los las una por".split()
MAX_BUCKETS = 65_536  # stretches of the id order; bounds what is broadcast
STRETCH = 1024  # rows that a stretch has, if ids are even


def signatures(text: Column) -> Column:
    """The sorted, distinct 32-bit signatures of a text."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[.,;:!?]+(?=[{WS}]|$)", "")
    words = F.filter(F.split(clean, f"[{WS}]"), lambda w: w != "")

    def chains(ws: Column) -> Column:
        tagged = F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(ws, i - 1), F.lit("")).alias("a")))
        content = F.filter(tagged, lambda e: ~e["w"].isin(ANCHORS))
        found = let(content, lambda c: F.filter(F.transform(c, lambda e, j: F.when(
            (j == 0) | e["a"].isin(ANCHORS), F.xxhash64(e["w"], F.coalesce(F.get(c, j + 1)["w"], F.lit(""))))), lambda h: h.isNotNull()))
        return let(found, lambda f: F.when((F.size(f) == 0) & (F.size(ws) > 0), F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(f))

    return F.array_sort(F.array_distinct(F.transform(let(words, chains), lambda h: F.shiftright(h, 32).cast("int"))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """The Jaccard index of two signature sets; 1 for two empty ones. Pairs whose lengths alone keep them under ``least`` get 0 unread."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(high == 0, 1.0).when((low == 0) | (low < high * least), 0.0).otherwise(both).cast("double")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, sigs, next struct of text and sigs) per row: the next row in ascending doc_id, the first after the last.

    The id order is cut into stretches, each of which one task orders; a copy of each stretch's head goes to the stretch before.
    Rows of the same id are ordered by text. Rows without an id are outside the order: nothing is next to them.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high, n = d.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    none = F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("sigs"))
    lone = d.filter(F.col("doc_id").isNull()).select("doc_id", "text", signatures(F.col("text")).alias("sigs"), none.alias("next"))
    if not n:
        return lone
    span = max(1, ceil((high - low + 1) * STRETCH / n), ceil((high - low + 1) / MAX_BUCKETS))
    stretch = F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(float(span))).cast("long")  # in doubles, as ids may span 64 bits; the order stays
    heads = sorted((r.b, r.h) for r in d.filter(F.col("doc_id").isNotNull()).groupBy(stretch.alias("b")).agg(F.min("doc_id").alias("h")).collect())
    before = [(h, heads[k - 1][0]) for k, (_, h) in enumerate(heads)]
    to = F.broadcast(d.sparkSession.createDataFrame(before, "head long, to long"))  # at most MAX_BUCKETS rows
    known = d.filter(F.col("doc_id").isNotNull()).withColumn("sigs", signatures(F.col("text")))
    spread = known.join(to, known["doc_id"] == to["head"], "left").select(
        "doc_id", "text", "sigs", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(stretch.alias("b"), F.lit(False).alias("copy")))).otherwise(
            F.array(F.struct(stretch.alias("b"), F.lit(False).alias("copy")), F.struct(F.col("to").alias("b"), F.lit(True).alias("copy"))))).alias("at"))
    order = Window.partitionBy("b").orderBy("copy", "doc_id", "text")
    flat = spread.select("doc_id", "text", "sigs", F.col("at.b").alias("b"), F.col("at.copy").alias("copy"))
    told = flat.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).filter(~F.col("copy"))
    return told.select("doc_id", "text", "sigs", "next").unionByName(lone)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of the text whose second half is replaced by the next text's beginning."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    e = with_next(docs, id_col, text_col).select("doc_id", n.cast("long").alias("n_chars"), "sigs", edited.alias("edited"), F.col("next.sigs").alias("next"))
    e = e.select("doc_id", "n_chars", "sigs", "next", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("changed"))
    return e.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("changed")).alias("near_edited"), likeness(F.col("sigs"), F.col("next")).alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"))


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"):
    """(members, pairs): doc_id and the class of equal sets it is in (its least doc_id); pairs of classes a < b of likeness ``least`` up.

    Sets meet if they are in the same or neighbouring length partitions, whose bounds grow by 1 / least, and share one of their
    rarest signatures, as sets of that likeness must. Equal sets are one class and never paired, empty sets are in no pair.
    """
    own = saved(docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col)).alias("sigs")))
    members = own.withColumn("key", fingerprint(F.col("sigs")))
    classes = saved(members.groupBy("key").agg(F.min("doc_id").alias("cls"), F.first("sigs").alias("sigs")))
    sets = classes.filter((F.size("sigs") > 0) & F.col("cls").isNotNull()).select("cls", "sigs", F.size("sigs").alias("n"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(least))).cast("int")
    items = sets.select("cls", "n", part.alias("part"), F.explode("sigs").alias("sig"))
    common = items.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = items.join(common, "sig").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("df", "sig")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a = prefix.select("sig", F.col("cls").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    b = prefix.select("sig", F.col("cls").alias("b"), F.col("n").alias("nb"), "part")
    met = a.join(b, ["sig", "part"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct()
    pairs = met.join(sets.select(F.col("cls").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("sigs").alias("sb")), "b")
    pairs = pairs.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).filter(F.col("likeness") >= least)
    return members.join(classes.select("key", "cls"), "key").select("doc_id", F.col("cls").alias("class_id")), pairs
