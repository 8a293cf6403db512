"""BM25, BM25F, feedback, PageRank and fusion, for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stems_of, stop_stems, terms
from ..sources.shared import remove, saved

FIELD_PARAMS = {"title": (4.0, 0.5), "body": (1.0, 0.75), "anchor": (2.5, 0.6)}


def idf(n_docs, df) -> Column:
    return F.when(df > 0, F.log((n_docs - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)


def _query_array(text: str, stemmed: bool) -> Column:
    ts = terms(F.col(text))
    return stems_of(ts) if stemmed else ts


def query_terms(queries: DataFrame, text: str = "text", stemmed: bool = True) -> DataFrame:
    """(query_id, term, w): each query's distinct terms with weight 1."""
    return queries.select("query_id", F.explode(F.array_distinct(_query_array(text, stemmed))).alias("term"), F.lit(1.0).alias("w"))


WANTED_ROWS = 1 << 20  # wanted terms up to this number go to the workers, else they are joined


LISTED = 10_000  # wanted terms up to this number are a filter, which the statistics of a stored index serve


def _small(df: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``df``, sent to the workers if it, or the wanted terms that it can't outnumber, are few."""
    return F.broadcast(df) if (df if wanted is None else wanted).count() <= WANTED_ROWS else df


def _of_terms(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted terms."""
    asked = wanted.select("term").distinct()
    few = [r.term for r in asked.limit(LISTED + 1).collect()]
    return rows.filter(F.col("term").isin(few)) if len(few) <= LISTED else rows.join(_small(asked), "term", "left_semi")


def bm25(index, wanted: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of an index for the weighted terms (query_id, term, w). Only the wanted terms' rows meet the lengths."""
    wanted = wanted.filter("w > 0").select("query_id", "term", "w")
    rows = _of_terms(index.frequencies, wanted)
    dfs = rows.groupBy("term").agg(F.count("*").alias("df"))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    part = rows.join(index.lengths, "doc_id").crossJoin(F.broadcast(index.stats)).select("term", "doc_id", "n", norm.alias("part"))  # stats is one row
    weighted = _small(wanted.join(dfs, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", (F.col("w") * idf(F.col("n"), F.col("df"))).alias("w")), wanted)
    return part.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def _soft(rows: DataFrame, index, params, keys: list[str]) -> DataFrame:
    """The weighted frequency x over fields by ``keys``, from rows with field, tf and len."""
    case = lambda i, other: F.coalesce(*[F.when(F.col("field") == f, F.lit(p[i])) for f, p in params.items()], F.lit(other))
    size = F.when(F.col("avg_len") > 0, 1 - case(1, 0.75) + case(1, 0.75) * F.col("len") / F.col("avg_len")).otherwise(1.0)
    soft = case(0, 1.0) * F.col("tf") / F.when(size > 0, size).otherwise(1.0)
    return rows.join(F.broadcast(index.field_stats.select("field", "avg_len")), "field").groupBy(*keys).agg(F.sum(soft).alias("x"))  # a row a field


def bm25f(index, wanted: DataFrame, k1: float = 1.2, params=FIELD_PARAMS) -> DataFrame:
    """The same over fields; ``params`` has weight and b by field. A term's documents are those that have it in any field."""
    wanted = wanted.filter("w > 0").select("query_id", "term", "w")
    rows = _of_terms(index.field_postings, wanted)
    per = _soft(rows.join(index.field_lengths, ["field", "doc_id"]), index, params, ["term", "doc_id"])
    dfs = rows.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    weighted = _small(wanted.join(dfs, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", (F.col("w") * idf(F.col("n"), F.col("df"))).alias("w")), wanted)
    return per.filter("x > 0").join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("x") * (k1 + 1) / (k1 + F.col("x"))).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_pagerank(scores: DataFrame, ranks: DataFrame, alpha: float = 1.0, beta: float = 100.0) -> DataFrame:
    return scores.join(ranks, "doc_id", "left").select("query_id", "doc_id", (F.col("score") + alpha * F.log1p(beta * F.coalesce("pagerank", F.lit(0.0)))).alias("score"))


@dataclass(frozen=True)
class PrfParams:
    """Of pseudo-relevance feedback; change fields with ``dataclasses.replace``."""

    docs: int = 5  # best documents taken as relevant
    terms: int = 5  # new terms
    alpha: float = 1.0  # weight of the query's own terms, by their number in it
    beta: float = 0.5  # weight of the feedback
    max_df: float = 0.4  # share of documents beyond which a term says nothing
    min_length: int = 3  # bytes
    stop: frozenset | None = None  # stems; None for the English list

    def stop_words(self) -> list[str]:
        return stop_stems() if self.stop is None else sorted(self.stop)


def query_counts(queries: DataFrame, text: str = "text", stemmed: bool = True) -> DataFrame:
    """(query_id, term, w): the number of times a term is in the query."""
    return queries.select("query_id", F.explode(_query_array(text, stemmed)).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("w"))


def _expand(seen: DataFrame, dfs: DataFrame, n_docs: DataFrame, own: DataFrame, p: PrfParams) -> DataFrame:
    """The weighted terms from (query_id, k, term, doc_id, part): ``part`` is the saturated frequency in one relevant document."""
    one = seen.join(dfs, "term").crossJoin(F.broadcast(n_docs)).filter(F.col("df") / F.col("n") <= p.max_df)  # n_docs is one row
    fb = one.groupBy("query_id", "term").agg(F.sum(p.beta / F.col("k") * idf(F.col("n"), F.col("df")) * F.col("part")).alias("fb")).filter("fb > 0")
    old = own.join(fb, ["query_id", "term"], "left").select("query_id", "term", (p.alpha * F.col("w") + F.coalesce("fb", F.lit(0.0))).alias("w"), F.lit(False).alias("new"))
    fresh = fb.join(own.select("query_id", "term"), ["query_id", "term"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("fb", 9)), "term"))
    return old.unionByName(fresh.withColumn("rn", rn).filter(F.col("rn") <= p.terms).select("query_id", "term", F.col("fb").alias("w"), F.lit(True).alias("new")))


def _relevant(scores: DataFrame, p: PrfParams) -> DataFrame:
    best = top(scores, p.docs).select("query_id", "doc_id")
    return best.join(best.groupBy("query_id").agg(F.count("*").alias("k")), "query_id")


def _candidates(tf: DataFrame, best: DataFrame, p: PrfParams) -> DataFrame:
    rows = tf.join(F.broadcast(best), "doc_id")  # p.docs rows a query
    return rows.filter((F.octet_length("term") >= p.min_length) & ~F.col("term").isin(p.stop_words()))


def expand_bm25(index, queries: DataFrame, p: PrfParams = PrfParams(), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, term, w, new): each query's terms and what its best documents by BM25 add to it."""
    own = query_counts(queries, stemmed=index.stemmed)
    best = saved(_relevant(bm25(index, own.withColumn("w", F.lit(1.0)), k1, b), p))
    seen = saved(_candidates(index.frequencies, best, p))
    dfs = _of_terms(index.frequencies, seen).groupBy("term").agg(F.count("*").alias("df"))  # terms of p.docs documents a query
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    sized = seen.join(index.lengths, "doc_id").crossJoin(F.broadcast(index.stats)).select("query_id", "k", "term", "doc_id", norm.alias("part"))
    return saved(_expand(sized, dfs, index.stats.select("n"), own, p))  # it is read more than once


def expand_bm25f(index, queries: DataFrame, p: PrfParams = PrfParams(), k1: float = 1.2, params=FIELD_PARAMS) -> DataFrame:
    """The same by BM25F over fields."""
    own = query_counts(queries, stemmed=index.stemmed)
    best = saved(_relevant(bm25f(index, own.withColumn("w", F.lit(1.0)), k1, params), p))
    seen = saved(_candidates(index.field_postings, best, p))
    dfs = _of_terms(index.field_postings, seen).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    soft = _soft(seen.join(index.field_lengths, ["field", "doc_id"]), index, params, ["query_id", "k", "term", "doc_id"])
    sized = soft.filter("x > 0").select("query_id", "k", "term", "doc_id", (F.col("x") * (k1 + 1) / (k1 + F.col("x"))).alias("part"))
    return saved(_expand(sized, dfs, index.stats.select("n"), own, p))  # it is read more than once


def query_strings(queries: DataFrame, expanded: DataFrame) -> DataFrame:
    """(query_id, text): each query with its new terms behind it, best first."""
    new = expanded.filter("new").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("o"), "term"))), lambda e: e["term"]).alias("ts"))
    return queries.join(new, "query_id", "left").select("query_id", F.concat_ws(" ", "text", F.array_join("ts", " ")).alias("text"))


def pagerank(edges: DataFrame, steps: int = 100, damping: float = 0.85, tol: float = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """(node, pagerank) from even ranks, until the ranks move by less than ``tol`` in all or ``steps`` rounds are done. Self-loops are dropped.

    ``nodes`` (node) adds nodes without an edge. Links with their out-degree are written once; each round is one join and one aggregation
    on them, and its ranks are written to the shared folder, so that no plan grows and a lost executor costs one round. What nodes
    without out-links hold spreads over all.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    held = e.select(F.col("src").alias("node")).union(e.select("dst"))
    if nodes is not None:
        held = held.union(nodes.select("node"))
    out = saved(e.join(e.groupBy("src").agg(F.count("*").alias("deg")), "src"))
    every = saved(held.distinct().join(out.select(F.col("src").alias("node")).distinct().withColumn("links", F.lit(True)), "node", "left"))
    n = every.count()
    if n <= 1:
        return every.select("node", F.lit(1.0).alias("pagerank"))
    ranks = saved(every.select("node", "links", F.lit(1.0 / n).alias("pagerank")))
    for _ in range(steps):
        loose = ranks.filter("links IS NULL").agg(F.sum("pagerank")).first()[0] or 0.0
        got = out.join(ranks.select(F.col("node").alias("src"), "pagerank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pagerank") / F.col("deg")).alias("in"))
        rank = (1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + loose / n)
        new = saved(ranks.withColumnRenamed("pagerank", "was").join(got, "node", "left").select("node", "links", rank.alias("pagerank"), F.abs(rank - F.col("was")).alias("moved")))
        remove(ranks)
        ranks = new
        if ranks.agg(F.sum("moved")).first()[0] < tol:
            break
    return ranks.select("node", "pagerank")


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of crawled (doc_id, url, links array): links to addresses that weren't crawled are left out, all documents are nodes."""
    ids = pages.groupBy("url").agg(F.min("doc_id").alias("dst"))
    to = pages.select(F.col("doc_id").alias("src"), F.explode("links").alias("url")).join(ids, "url")
    return to.filter("src <> dst").select("src", "dst").distinct(), pages.select(F.col("doc_id").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, out_neighbors, in_neighbors) of all nodes of the distinct links."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("o"), F.lit(None).cast("long").alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("o"), F.col("src").alias("i")))
    return both.groupBy("node").agg(F.count("o").alias("out_degree"), F.count("i").alias("in_degree"), F.array_sort(F.collect_list("o")).alias("out_neighbors"), F.array_sort(F.collect_list("i")).alias("in_neighbors"))


def fuse_rrf(lexical: DataFrame, semantic: DataFrame, k: float = 60.0, w=(0.55, 0.45)) -> DataFrame:
    """Reciprocal ranks of two ranked lists (query_id, doc_id, rank)."""
    j = lexical.select("query_id", "doc_id", F.col("rank").alias("a")).join(semantic.select("query_id", "doc_id", F.col("rank").alias("b")), ["query_id", "doc_id"], "full_outer")
    return j.select("query_id", "doc_id", (F.coalesce(w[0] / (k + F.col("a")), F.lit(0.0)) + F.coalesce(w[1] / (k + F.col("b")), F.lit(0.0))).alias("score"))


def fuse_linear(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Min-max of the lexical scores beside (cosine + 1) / 2; a missing lexical score is 0, a missing cosine too."""
    bounds = lexical.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    j = lexical.select("query_id", "doc_id", F.col("score").alias("x")).join(semantic.select("query_id", "doc_id", F.col("score").alias("c")), ["query_id", "doc_id"], "full_outer").join(bounds, "query_id", "left")
    lex = F.when(F.col("hi") > F.col("lo"), (F.coalesce("x", F.lit(0.0)) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    sem = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce("c", F.lit(0.0)) + 1) / 2))
    return j.select("query_id", "doc_id", (alpha * lex + (1 - alpha) * sem).alias("score"))
