"""The continuous crawl: a stream of page files, each address indexed once, ranks renewed every few pages.

``CrawlStream`` runs one streaming query. What is known of addresses is the state of the stream's own deduplication; with a watermark on
arrival times it is bounded. Each micro-batch goes through ``foreachBatch`` into the store: pages, one index segment a batch, metadata.
A batch that is run again after a failure overwrites its own folders, so the store has it once. Pausing stops the query at the end of its
batch; resuming starts it from its checkpoint.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import index as ix
from ..operators import ranking
from ..operators.crawl import normalize_url, page_fields

PAGES = "page_id long, url string, html string"


@dataclass
class Telemetry:
    state: str = "idle"  # idle, running, paused, stopped
    pages: int = 0
    duplicates: int = 0
    failed: int = 0
    links: int = 0
    batches: int = 0
    ranked: int = 0
    errors: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


class Store:
    """The tables that a crawl fills: a folder a batch, so a batch is added whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", batch int").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*").drop("batch")
        except Exception:
            return self.spark.createDataFrame([], schema)

    def pages(self) -> DataFrame:
        return self.read("pages", "doc_id long, url string, title string, body string, links array<string>")

    def index(self) -> ix.Index:
        return ix.Index(self.read("postings", ix.POSTINGS), self.read("lengths", ix.LENGTHS), self.read("field_postings", ix.FIELD_POSTINGS), self.read("field_lengths", ix.FIELD_LENGTHS))

    def ranks(self) -> DataFrame:
        return self.read("ranks", "node long, pagerank double")

    def metadata(self) -> DataFrame:
        """(doc_id, url, title, body, pagerank) with the ranks known; 0 where there is none yet."""
        r = self.ranks().select(F.col("node").alias("doc_id"), "pagerank")
        return self.pages().join(r, "doc_id", "left").select("doc_id", "url", "title", "body", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))


class Sink:
    """What a crawl calls; the methods may be replaced."""

    def on_documents(self, pages: DataFrame) -> None:
        """After a batch's pages (doc_id, url, title, body, links) are stored."""

    def on_pagerank(self, ranks: DataFrame) -> None:
        """After new ranks (node, pagerank) are stored."""


class CrawlStream:
    def __init__(self, spark: SparkSession, source: str, store: str, max_pages: int | None = None, rank_every: int = 100, sink: Sink | None = None):
        self.spark, self.source, self.store, self.path = spark, source, Store(spark, store), store.rstrip("/")
        self.max_pages, self.rank_every, self.sink = max_pages, rank_every, sink or Sink()
        self.telemetry, self.query, self._ranked_at = Telemetry(), None, 0

    def stream(self) -> DataFrame:
        """The pages that arrive, each canonical address once."""
        raw = self.spark.readStream.schema(PAGES).parquet(self.source)
        return raw.withColumn("url", normalize_url(F.col("url"))).dropDuplicates(["url"])

    def start(self, once: bool = False) -> "CrawlStream":
        """Starts, or goes on from the checkpoint; ``once`` ends after what is there now."""
        if self.is_running():
            return self
        writer = self.stream().writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")
        self.telemetry.state = "running"
        self.query = writer.start()
        return self

    def pause(self) -> None:
        self._halt("paused")

    def resume(self, once: bool = False) -> "CrawlStream":
        return self.start(once)

    def stop(self) -> None:
        """Ends, with last ranks."""
        self._halt("stopped")
        self.rank()

    def _halt(self, state: str) -> None:
        if self.query is not None:
            while self.query.isActive and self.query.status["isTriggerActive"]:
                time.sleep(0.05)
            self.query.stop()
        self.telemetry.state = state

    def wait(self) -> "CrawlStream":
        self.query.awaitTermination()
        self.telemetry.state = "idle"
        return self

    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def enqueue(self, pages: DataFrame) -> None:
        """Adds pages (page_id, url, html) to what is to be read."""
        pages.select("page_id", "url", "html").write.mode("append").parquet(self.source)

    def _batch(self, raw: DataFrame, number: int) -> None:
        t = self.telemetry
        known = self.store.pages().filter(F.col("doc_id").isNotNull())
        room = None if self.max_pages is None else self.max_pages - known.count()
        good = raw.filter("url IS NOT NULL AND html IS NOT NULL").join(known.select("url"), "url", "left_anti")
        if room is not None:
            good = good.orderBy("page_id").limit(max(0, room))
        base = known.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
        # ids within a batch: a batch is bounded by what has arrived
        fresh = good.withColumn("doc_id", (F.row_number().over(Window.orderBy("page_id", "url")) + F.lit(base - 1)).cast("long"))
        self.store.write("pages", number, fresh.select("doc_id", "url", *page_fields(F.col("url"), F.col("html"))).withColumnRenamed("text", "body"))
        pages = self.spark.read.parquet(f"{self.path}/pages/batch={number}")
        n = pages.count()
        if n:
            text = F.when(F.col("title") == "", F.col("body")).otherwise(F.concat_ws(" ", "title", "body"))
            rows = ix.split_fields(pages.select("doc_id", "title", "body", F.lit("").alias("anchor")))
            segment = ix.Index.build(pages.select("doc_id", text.alias("text")), rows)
            for name, table in (("postings", segment.postings), ("lengths", segment.lengths), ("field_postings", segment.field_postings), ("field_lengths", segment.field_lengths)):
                self.store.write(name, number, table)
        t.batches += 1
        t.pages += n
        t.links += pages.agg(F.coalesce(F.sum(F.size("links")), F.lit(0))).first()[0]
        self.sink.on_documents(pages)
        if t.pages - self._ranked_at >= self.rank_every:
            self.rank()

    def rank(self) -> None:
        """Ranks of all pages so far, over their links to one another."""
        edges, nodes = ranking.link_graph(self.store.pages())
        ranks = ranking.pagerank(edges, nodes=nodes)
        ranks.write.mode("overwrite").parquet(f"{self.path}/ranks/batch=0")
        self._ranked_at = self.telemetry.pages
        self.telemetry.ranked += 1
        self.sink.on_pagerank(self.store.ranks())


def ingest(meta: DataFrame, pages: DataFrame, first_rank: float = 0.0) -> DataFrame:
    """Metadata (doc_id, url, title, body, pagerank) with pages (url, title, body) taken in: a known address keeps its id and gets the new title and text where they
    aren't empty, a new one gets the next id. Of pages with one address the last by title and text counts."""
    new = pages.groupBy("url").agg(F.max(F.struct("title", "body")).alias("p")).select("url", "p.*")
    old = meta.join(new.select("url", F.col("title").alias("t"), F.col("body").alias("b")), "url", "left").select(
        "doc_id", "url", F.when(F.coalesce("t", F.lit("")) != "", F.col("t")).otherwise(F.col("title")).alias("title"),
        F.when(F.coalesce("b", F.lit("")) != "", F.col("b")).otherwise(F.col("body")).alias("body"), "pagerank")
    base = meta.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("base"))
    fresh = new.join(meta.select("url"), "url", "left_anti").crossJoin(F.broadcast(base))  # base is one row
    number = F.row_number().over(Window.orderBy("url")) - 1  # over one batch's new addresses
    return old.unionByName(fresh.select((F.col("base") + number).cast("long").alias("doc_id"), "url", "title", "body", F.lit(first_rank).alias("pagerank")))


def update_pageranks(meta: DataFrame, ranks: DataFrame) -> DataFrame:
    """Metadata with the ranks of (node, pagerank); documents without one keep theirs."""
    r = ranks.select(F.col("node").alias("doc_id"), F.col("pagerank").alias("_new"))
    return meta.join(r, "doc_id", "left").select("doc_id", "url", "title", "body", F.coalesce("_new", "pagerank").alias("pagerank"))
