"""Retrieval metrics over all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_query(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """rankings (query_id, doc_id, rank), qrels (query_id, doc_id, grade): p, r, rr, ap, ndcg by query; grade 0 is not relevant."""
    rel = qrels.filter("grade > 0")
    total = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = rel.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).filter(F.col("i") <= k).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("i") + 1)).alias("idcg"))
    hits = rankings.join(rel, ["query_id", "doc_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = F.when(F.col("rank") <= k, 1).otherwise(0)
    got = hits.groupBy("query_id").agg(F.sum(at).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"), F.sum(at * (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(got, "query_id", "left").join(ideal, "query_id", "left").select(
        "query_id", z(F.col("hits") / k).alias("p"), z(F.col("hits") / F.col("n")).alias("r"), z(1 / F.col("first")).alias("rr"), z(F.col("precisions") / F.col("n")).alias("ap"), z(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def means(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: the means of ``per_query`` over the judged queries."""
    return per_query(rankings, qrels, k).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("p", "r", "rr", "ap", "ndcg")])


SUITES = {
    "seven": (("map", "ap", 10), ("mrr", "rr", 10), ("p5", "p", 5), ("p10", "p", 10), ("r10", "r", 10), ("ndcg5", "ndcg", 5), ("ndcg10", "ndcg", 10)),
    "eight": (("p1", "p", 1), ("p3", "p", 3), ("p5", "p", 5), ("r3", "r", 3), ("r5", "r", 5), ("mrr", "rr", 5), ("ndcg3", "ndcg", 3), ("ndcg5", "ndcg", 5)),
}


def suite(rankings: DataFrame, qrels: DataFrame, name: str = "seven") -> DataFrame:
    """(metric, value) of a named set of metrics, each at its own cut."""
    out = None
    for k in sorted({k for _, _, k in SUITES[name]}):
        row = means(rankings, qrels, k)
        got = row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c, at in SUITES[name] if at == k])))
        out = got if out is None else out.unionByName(got)
    return out


def lift(base, candidate):
    """The gain in percent; over next to nothing it is 100, or 0 for next to nothing."""
    return F.when(base <= 1e-9, F.when(candidate > 1e-9, 100.0).otherwise(0.0)).otherwise((candidate - base) / base * 100)


def compare(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, lift) of two rows of ``means``."""
    b, c = base.select([F.col(x).alias(f"b_{x}") for x in base.columns]), candidate.select([F.col(x).alias(f"c_{x}") for x in candidate.columns])
    both = b.crossJoin(F.broadcast(c))  # one row each
    rows = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"b_{x}").alias("baseline"), F.col(f"c_{x}").alias("candidate"), lift(F.col(f"b_{x}"), F.col(f"c_{x}")).alias("lift")) for x in base.columns])
    return both.select(F.inline(rows))


def table(rows: list, k: int) -> str:
    """The comparison as a Markdown table."""
    names = {"p": f"precision@{k}", "r": f"recall@{k}", "rr": "MRR", "ap": "MAP", "ndcg": f"NDCG@{k}"}
    lines = ["| metric | baseline | candidate | lift |", "|-|-|-|-|"]
    return "\n".join(lines + [f"| {names.get(r.metric, r.metric)} | {r.baseline:.4f} | {r.candidate:.4f} | {r.lift:+.2f} % |" for r in rows])


def binary(rows: DataFrame) -> DataFrame:
    """Judgments of grade 1 from (query_id, doc_id)."""
    return rows.select("query_id", "doc_id", F.lit(1).alias("grade"))


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.filter("grade > 0").select("query_id", "doc_id")
