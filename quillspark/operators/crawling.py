"""A crawl as waves: each takes one address of every host, fetches all of them in one job, and pushes the links found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import saved
from .crawl import Frontier, page_fields, url_parts
from .robots import allowed_udf

DOCS = "doc_id long, url string, title string, text string, links array<string>"


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 100
    respect_robots: bool = True
    agent: str = "quillspark/0.1"


@dataclass
class CrawlResult:
    documents: DataFrame
    frontier: Frontier
    visited: int = 0
    failed: int = 0
    disallowed: int = 0
    discovered: int = 0
    waves: int = 0

    def content(self) -> DataFrame:
        """(doc_id, text) to index: the title before the text."""
        return self.documents.select("doc_id", F.when(F.col("title") == "", F.col("text")).otherwise(F.concat_ws(" ", "title", "text")).alias("text"))


def crawl(spark, fetcher, seeds: list[str], config: CrawlConfig = CrawlConfig(), first_id: int = 1) -> CrawlResult:
    """Breadth first from the seeds until nothing waits or max_pages are visited; doc_ids go up in the order of waves and addresses.

    Per wave there are a fetch of the robots files of hosts not met before, one of the pages, and a written table; only counts come to
    the driver. A wave takes at most as many pages as are left, the first in order.
    """
    frontier = Frontier.empty(spark).push(spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, seq long"))
    frontier = Frontier(saved(frontier.table))
    out = CrawlResult(spark.createDataFrame([], DOCS), frontier)
    robots = spark.createDataFrame([], "host string, robots string")
    next_seq = len(seeds)
    while out.visited < config.max_pages and not frontier.is_empty():
        out.waves += 1
        wave = frontier.pop_polite().orderBy("seq", "url").limit(config.max_pages - out.visited).withColumn("p", url_parts(F.col("url")))
        if config.respect_robots:
            sites = wave.select("host", F.concat(F.col("p.scheme"), F.lit("://"), "host", F.lit("/robots.txt")).alias("url")).join(robots, "host", "left_anti")
            got = fetcher.fetch(sites.select("url")).select(F.col("url").alias("at"), F.col("html").alias("robots"))
            robots = saved(robots.unionByName(sites.join(got, sites["url"] == got["at"], "left").select("host", "robots")))
            path = F.concat(F.col("p.path"), F.when(F.col("p.query") == "", "").otherwise(F.concat(F.lit("?"), F.col("p.query"))))
            wave = wave.join(robots, "host", "left").withColumn("ok", allowed_udf("robots", config.agent, path))
        else:
            wave = wave.withColumn("ok", F.lit(True))
        wave = saved(wave.select("url", "host", "seq", "ok"))
        pages = fetcher.fetch(wave.filter("ok").select("url")).join(wave.select("url", "seq"), "url")
        here = first_id + out.visited - 1
        number = F.row_number().over(Window.orderBy("seq", "url"))  # at most one page a host and wave
        good = pages.filter("html IS NOT NULL").select((number + here).cast("long").alias("doc_id"), "url", *page_fields(F.col("url"), F.col("html")))
        good = saved(good)
        n, tried, asked = good.count(), wave.filter("ok").count(), wave.count()
        found = good.select("doc_id", F.posexplode("links").alias("at", "url")).withColumn("seq", F.row_number().over(Window.orderBy("doc_id", "at")) + next_seq)
        next_seq += good.agg(F.coalesce(F.sum(F.size("links")), F.lit(0))).first()[0]
        before = frontier.seen_count()
        frontier = Frontier(saved(frontier.done(wave).push(found.select("url", F.col("seq").cast("long").alias("seq"))).table))
        out.documents = out.documents.unionByName(good)
        out.visited, out.failed, out.disallowed = out.visited + n, out.failed + tried - n, out.disallowed + asked - tried
        out.discovered += frontier.seen_count() - before
    out.frontier = frontier
    return out
