"""The engine: an index, its fields, vectors, counts and metadata behind one interface."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.snippet import snippet_udf
from .operators import boolean, evaluate, ranking, suggest
from .operators import index as ix
from .operators.crawling import CrawlConfig, crawl
from .operators.hybrid import HybridParams, fuse, parse_mode
from .operators.vectors import VectorIndex, embed, embed_udf
from .sources import index_store
from .sources.shared import saved
from .streaming.crawl import ingest, update_pageranks

DIMENSION = 64
DEMO = (
    ("https://quill.test/spark", "Query plans in Spark", "A declarative query becomes a logical plan. The optimizer prunes columns, pushes filters into the scan and picks a join."),
    ("https://quill.test/index", "Inverted index", "An inverted index maps each term to its postings: the documents that hold it, how often and where. Phrase search compares positions."),
    ("https://quill.test/bm25", "Ranking with BM25", "BM25 weighs a term by how rare it is and saturates its frequency. Long documents are held back by their length."),
    ("https://quill.test/pagerank", "PageRank of a web graph", "PageRank follows links at random. A page is important if important pages link to it. Dangling pages share their rank with all."),
    ("https://quill.test/crawler", "A polite web crawler", "A crawler reads robots files, waits between visits to one host, and keeps a frontier of addresses it has not seen."),
    ("https://quill.test/vectors", "Vectors and semantic search", "An embedding maps text to a vector. Similar meanings are near one another, so a search finds a vehicle when asked for a car."),
)


@dataclass
class Engine:
    """Tables of one collection. ``meta`` is (doc_id, url, title, body, pagerank); all else is made from it, once, when first asked for."""

    spark: SparkSession
    meta: DataFrame
    params: HybridParams = field(default_factory=HybridParams)

    @classmethod
    def of_pages(cls, spark: SparkSession, pages: DataFrame) -> "Engine":
        """Of (doc_id, url, title, body), without ranks."""
        return cls(spark, saved(pages.select("doc_id", "url", "title", "body", F.lit(0.0).alias("pagerank"))))

    @classmethod
    def demo(cls, spark: SparkSession) -> "Engine":
        rows = [(k, *r, 0.0) for k, r in enumerate(DEMO)]
        return cls(spark, spark.createDataFrame(rows, index_store.META))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Engine":
        """From a folder that ``save`` wrote; without metadata, documents get placeholder titles."""
        index = index_store.load(spark, f"{path}/index")
        try:
            meta = index_store.load_metadata(spark, f"{path}/meta")
        except index_store.StorageError as e:
            if e.kind != "io":
                raise
            meta = index.doc_ids().select("doc_id", F.lit("").alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("body"), F.lit(0.0).alias("pagerank"))
        out = cls(spark, meta)
        out.__dict__["index"] = index
        return out

    def save(self, path: str) -> None:
        index_store.save(self.index, f"{path}/index")
        index_store.save_metadata(self.meta, f"{path}/meta")

    # the tables, made on first use and written to the shared folder

    @property
    def combined(self) -> DataFrame:
        return self.meta.select("doc_id", F.when(F.col("title") == "", F.col("body")).otherwise(F.concat_ws(" ", "title", "body")).alias("text"))

    @cached_property
    def index(self) -> ix.Index:
        rows = ix.split_fields(self.meta.select("doc_id", "title", "body", F.lit("").alias("anchor")))
        made = ix.Index.build(self.combined, rows)
        return ix.Index(saved(made.postings), saved(made.lengths), saved(made.field_postings), saved(made.field_lengths))

    @cached_property
    def vectors(self) -> VectorIndex:
        v = VectorIndex(self.combined.select("doc_id", embed_udf("text", DIMENSION).alias("v")), DIMENSION)
        return v._with(saved(v.vectors))

    @cached_property
    def completions(self) -> DataFrame:
        return saved(suggest.merge(suggest.grams(self.combined, 3)))

    @cached_property
    def words(self) -> DataFrame:
        return saved(suggest.merge(suggest.grams(self.combined, 1)))

    def _asked(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, text)], "query_id int, text string")

    # searching

    def search(self, text: str, k: int = 20, mode: str = "hybrid", alpha: float | None = None, params: HybridParams | None = None) -> DataFrame:
        """Hybrid search: (rank, doc_id, score, bm25f_score, similarity, pagerank, lexical_rank, semantic_rank), best first."""
        p = replace(params or self.params, mode=parse_mode(mode), alpha=alpha)
        text = text.strip()
        lexical = semantic = None
        if p.mode != "semantic":
            lexical = ranking.top(ranking.bm25f(self.index, ranking.query_terms(self._asked(text)), params=p.fields), p.candidates)
        if p.mode != "lexical":
            q = self.spark.createDataFrame([(1, embed(text, DIMENSION))], "query_id int, q array<double>")
            semantic = self.vectors.search(q, p.candidates)
        if not text:
            lexical = lexical.limit(0) if lexical is not None else None
            semantic = semantic.limit(0) if semantic is not None else None
        return ranking.top(fuse(lexical, semantic, self.meta.select("doc_id", "pagerank"), p), k).drop("query_id")

    def results(self, text: str, k: int = 20, mode: str = "hybrid", alpha: float | None = None, tags="html", most: int = 180) -> tuple[DataFrame, str | None]:
        """The found pages with snippets, and what was searched instead where the query as it is finds nothing."""
        found, instead = saved(self.search(text, k, mode, alpha)), None
        if found.isEmpty() and text.strip():
            instead = self.correct(text)
            if instead:
                found = saved(self.search(instead, k, mode, alpha))
        return self._shown(found, instead or text, tags, most), instead

    def _shown(self, found: DataFrame, query: str, tags, most: int) -> DataFrame:
        """(…, title, url, snippet) of at most a page of results."""
        m = self.meta.select("doc_id", "title", "url", "body").join(F.broadcast(found), "doc_id")  # found has k rows
        return m.withColumn("snippet", snippet_udf("body", query, most, tags)).drop("body").orderBy("rank")

    def bm25(self, text: str, k: int = 10) -> DataFrame:
        """BM25 with PageRank: (doc_id, score, rank)."""
        s = ranking.bm25(self.index, ranking.query_terms(self._asked(text)))
        return ranking.top(ranking.with_pagerank(s, self.meta.select("doc_id", "pagerank")), k).drop("query_id")

    def prf(self, text: str, k: int = 10, params: ranking.PrfParams = ranking.PrfParams()) -> DataFrame:
        return ranking.top(ranking.bm25(self.index, ranking.expand_bm25(self.index, self._asked(text), params)), k).drop("query_id")

    def expand(self, text: str, params: ranking.PrfParams = ranking.PrfParams()) -> DataFrame:
        """(term, w, new)."""
        return ranking.expand_bm25(self.index, self._asked(text), params).drop("query_id").orderBy(F.desc("new"), F.desc("w"), "term")

    def boolean(self, text: str) -> DataFrame:
        return boolean.run(text, self.index)

    def suggest(self, prefix: str, k: int = 8) -> DataFrame:
        return suggest.suggest(self.completions, prefix, k)

    def correct(self, text: str) -> str | None:
        row = suggest.spell_queries(self.words, self._asked(text)).first()
        return row.corrected if row else None

    def stats(self) -> dict:
        s = self.index.stats.first()
        return {"total_documents": int(s.n), "vocabulary_size": self.index.postings.select("term").distinct().count(), "average_doc_length": round(s.avg, 2), "vector_index_size": self.vectors.size()}

    # change

    def ingest(self, pages: DataFrame) -> "Engine":
        """With pages (url, title, body) taken in."""
        return Engine(self.spark, saved(ingest(self.meta, pages)), self.params)

    def update_pageranks(self, ranks: DataFrame) -> "Engine":
        out = Engine(self.spark, saved(update_pageranks(self.meta, ranks)), self.params)
        for name in ("index", "vectors", "completions", "words"):  # none of them depends on ranks
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name]
        return out

    @classmethod
    def recrawl(cls, spark: SparkSession, fetcher, seeds: list[str], config: CrawlConfig = CrawlConfig()):
        """(engine, crawl result): a crawl, its ranks and an engine of its pages; None for an engine without pages."""
        got = crawl(spark, fetcher, seeds, config)
        if not got.visited:
            return None, got
        edges, nodes = ranking.link_graph(got.documents)
        ranks = ranking.pagerank(edges, nodes=nodes)
        return cls.of_pages(spark, got.documents.withColumnRenamed("text", "body")).update_pageranks(ranks), got

    # JSON answers

    def search_json(self, text: str, k: int = 20, mode: str = "hybrid", alpha: float | None = None) -> str:
        start, name = time.time(), parse_mode(mode)
        if not text.strip():
            return json.dumps({"query": "", "mode": name, "total": 0, "took_ms": 0.0, "did_you_mean": None, "results": []})
        rows, instead = self.results(text, k, mode, alpha)
        cut = lambda c: F.round(c, 4).alias(c)
        shown = rows.select("doc_id", "rank", cut("score"), F.round("bm25f_score", 4).alias("bm25_score"), F.round("similarity", 4).alias("semantic_similarity"), cut("pagerank"), "title", "url", "snippet")
        items = [json.loads(r.j) for r in shown.select("rank", F.to_json(F.struct(*shown.columns)).alias("j")).orderBy("rank").collect()]
        return json.dumps({"query": text.strip(), "mode": name, "total": len(items), "took_ms": round((time.time() - start) * 1000, 2), "did_you_mean": instead, "results": items}, ensure_ascii=False)

    def suggest_json(self, prefix: str, k: int = 8) -> str:
        items = [{"term": r.term, "frequency": r.tf, "doc_frequency": r.df} for r in self.suggest(prefix, k).collect()]
        return json.dumps({"prefix": prefix, "suggestions": items}, ensure_ascii=False)

    def stats_json(self) -> str:
        return json.dumps(self.stats())

    # the command router

    def run(self, line: str, k: int = 10):
        """What a line asks for: (kind, DataFrame or dict). Commands begin with a colon; quotes make a phrase, a closing star a prefix,
        operators a boolean query, anything else a ranked search, spelled right if it finds nothing."""
        line = line.strip()
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        if word == ":help":
            return "help", {"commands": HELP}
        if word == ":stats":
            return "stats", self.stats()
        if word == ":docs":
            return "docs", self.meta.select("doc_id", "title", "url", "pagerank").orderBy("doc_id")
        if word == ":suggest":
            return "suggest", self.suggest(rest, k)
        if word == ":expand":
            return "expand", self.expand(rest)
        if word == ":prf":
            return "prf", self.prf(rest, k)
        if word == ":query":
            return "boolean", self.boolean(rest)
        if word in (":and", ":or"):
            return "boolean", self.boolean(f" {word[1:].upper()} ".join(rest.split()))
        if word == ":save":
            self.save(rest)
            return "save", {"path": rest}
        if word == ":load":
            return "load", Engine.load(self.spark, rest)
        if word.startswith(":"):
            raise ValueError(f"unknown command {word}")
        if len(line) > 1 and line.startswith('"') and line.endswith('"') and line.count('"') == 2:
            return "phrase", self.boolean(line)
        if line.endswith("*") and " " not in line:
            return "prefix", self.boolean(line)
        if is_boolean(line):
            return "boolean", self.boolean(line)
        found = saved(self.bm25(line, k))
        if found.isEmpty() and (instead := self.correct(line)):
            found = saved(self.bm25(instead, k))
        return "ranked", found

    def evaluate(self, queries: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
        """BM25 beside BM25 with PageRank over judged queries (query_id, text): metric, both means, the lift in percent."""
        base = ranking.bm25(self.index, ranking.query_terms(queries))
        mixed = ranking.with_pagerank(base, self.meta.select("doc_id", "pagerank"))
        return evaluate.compare(evaluate.means(ranking.top(base, 1 << 30), qrels, k), evaluate.means(ranking.top(mixed, 1 << 30), qrels, k))


HELP = (":stats", ":docs", ":suggest PREFIX", ":expand QUERY", ":prf QUERY", ":query BOOLEAN", ":and WORDS", ":or WORDS", ":save FOLDER", ":load FOLDER", '"PHRASE"', "PREFIX*", "QUERY")


def is_boolean(line: str) -> bool:
    """Whether a line has operators of the boolean language."""
    words = line.split()
    return any(w in ("AND", "OR", "NOT") for w in words) or any(c in line for c in '()"!') or "&&" in line or "||" in line or any(w.startswith("-") and len(w) > 1 for w in words)
