"""Hybrid search: BM25F and vectors, each with its best candidates, fused and weighted by PageRank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import FIELD_PARAMS


def parse_mode(name: str) -> str:
    """lexical (or bm25), semantic (or vector), else hybrid."""
    return {"lexical": "lexical", "bm25": "lexical", "semantic": "semantic", "vector": "semantic"}.get(name.strip().lower(), "hybrid")


@dataclass(frozen=True)
class HybridParams:
    mode: str = "hybrid"
    alpha: float | None = None  # None fuses by ranks, else linearly
    rrf_k: float = 60.0
    lexical_weight: float = 0.55
    semantic_weight: float = 0.45
    candidates: int = 60  # of each channel
    include_pagerank: bool = True
    pagerank_weight: float = 15.0
    fields: dict = field(default_factory=lambda: dict(FIELD_PARAMS))


def fuse(lexical: DataFrame | None, semantic: DataFrame | None, ranks: DataFrame | None = None, params: HybridParams = HybridParams()) -> DataFrame:
    """Ranked lists (query_id, doc_id, score, rank) to (query_id, doc_id, score, bm25f_score, similarity, pagerank, lexical_rank, semantic_rank)."""
    some = lexical if lexical is not None else semantic
    none = some.limit(0)
    a = (lexical if lexical is not None else none).filter(F.col("rank") <= params.candidates).select("query_id", "doc_id", F.col("score").alias("x"), F.col("rank").alias("lexical_rank"))
    b = (semantic if semantic is not None else none).filter(F.col("rank") <= params.candidates).select("query_id", "doc_id", F.col("score").alias("c"), F.col("rank").alias("semantic_rank"))
    bounds = a.groupBy("query_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer").join(F.broadcast(bounds), "query_id", "left")  # a row a query
    if ranks is None:
        j = j.withColumn("pagerank", F.lit(0.0))
    else:
        j = j.join(ranks.select("doc_id", "pagerank"), "doc_id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    base = base_score(params)
    score = F.when(F.col("pagerank") > 0, base * (1 + F.log1p(params.pagerank_weight * F.col("pagerank")))).otherwise(base) if params.include_pagerank else base
    return j.select("query_id", "doc_id", score.alias("score"), F.coalesce("x", F.lit(0.0)).alias("bm25f_score"), F.coalesce("c", F.lit(0.0)).alias("similarity"), "pagerank", "lexical_rank", "semantic_rank")


def base_score(params: HybridParams) -> Column:
    x, c = F.coalesce("x", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    if params.mode == "lexical":
        return x
    if params.mode == "semantic":
        return c
    if params.alpha is None:
        part = lambda w, r: F.coalesce(w / (params.rrf_k + F.col(r)), F.lit(0.0))
        return part(params.lexical_weight, "lexical_rank") + part(params.semantic_weight, "semantic_rank")
    alpha = min(1.0, max(0.0, params.alpha))
    lex = F.when(F.col("hi") > F.col("lo"), (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return alpha * lex + (1 - alpha) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2))
