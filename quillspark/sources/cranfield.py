"""Test collections in the Cranfield layout: tagged documents, tagged queries, TREC judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tag(block: Column, name: str) -> Column:
    """What stands in the first ``<name>`` element; empty if there is none."""
    return F.regexp_extract(block, f"(?s)<{name}>(.*?)</{name}>", 1)


def _clean(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "^\\s+|\\s+$", ""), "\n", " ")


def _blocks(contents: DataFrame, name: str) -> DataFrame:
    """(file order, block) of each element in the texts of ``contents``."""
    return contents.select(F.posexplode(F.regexp_extract_all("value", F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))).alias("at", "b"))


def _number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, "^\\s*([0-9]+)\\s*$", 1).try_cast("long"), F.lit(0))


def parse_docs(contents: DataFrame) -> DataFrame:
    """(doc_id, title, body) of whole files in column value; a number that can't be read is 0."""
    return _blocks(contents, "doc").select(_number(tag(F.col("b"), "docno")).alias("doc_id"), _clean(tag(F.col("b"), "title")).alias("title"), _clean(tag(F.col("b"), "text")).alias("body"))


def parse_queries(contents: DataFrame) -> DataFrame:
    """(seq, raw_id, query) in the order of the file, seq from 1."""
    return _blocks(contents, "top").select((F.col("at") + 1).cast("long").alias("seq"), _number(tag(F.col("b"), "num")).alias("raw_id"), _clean(tag(F.col("b"), "title")).alias("query"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(qid, doc_id, grade) of TREC lines in column value: four columns at least, grade above 0; the last of equal pairs counts."""
    p = F.split(F.trim("value"), "\\s+")
    rows = lines.select(F.monotonically_increasing_id().alias("at"), p.alias("p")).filter(F.size("p") >= 4)
    got = rows.select("at", F.get("p", F.lit(0)).try_cast("long").alias("qid"), F.get("p", F.lit(2)).try_cast("long").alias("doc_id"), F.get("p", F.lit(3)).try_cast("int").alias("grade"))
    good = got.filter((F.col("qid") >= 0) & (F.col("doc_id") >= 0) & (F.col("grade") > 0))
    return good.groupBy("qid", "doc_id").agg(F.max_by("grade", "at").alias("grade"))


def join_judgments(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, query, doc_id, grade): judgments go by a query's place in its file, by its own number if that place has none."""
    known = qrels.select("qid").distinct()
    by = queries.join(known, queries["seq"] == known["qid"], "left").select("seq", "raw_id", "query", F.coalesce("qid", "raw_id").alias("qid"))
    return by.join(qrels, "qid").select(F.col("seq").alias("query_id"), "query", "doc_id", "grade")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, judgments) of the three files in a folder."""
    whole = lambda name: spark.read.text(f"{folder}/{name}", wholetext=True)
    qrels = parse_qrels(spark.read.text(f"{folder}/cranqrel.trec.txt"))
    return parse_docs(whole("cran.all.1400.xml")), join_judgments(parse_queries(whole("cran.qry.xml")), qrels)
