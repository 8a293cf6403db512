"""Where pages come from: a table, or the network."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.crawl import normalize_url

KINDS = ("text/html", "text/plain", "application/xhtml+xml")
FETCHED = "url string, html string, error string"


@dataclass
class TableFetcher:
    """Pages of a table (url, html), looked up by canonical address; an address without a page has the error ``404 Not Found``."""

    pages: DataFrame

    def fetch(self, urls: DataFrame) -> DataFrame:
        have = self.pages.select(normalize_url(F.col("url")).alias("_key"), F.col("html")).filter("_key IS NOT NULL").groupBy("_key").agg(F.max("html").alias("html"))
        asked = urls.select("url", normalize_url(F.col("url")).alias("_key"))
        return asked.join(have, "_key", "left").select("url", "html", F.when(F.col("html").isNull(), "404 Not Found").alias("error"))

    def add(self, url: str, html: str) -> "TableFetcher":
        new = self.pages.sparkSession.createDataFrame([(url, html)], "url string, html string")
        return TableFetcher(self.pages.select("url", "html").unionByName(new))


def _open(request, timeout: float):
    return urllib.request.urlopen(request, timeout=timeout)


@dataclass
class HttpFetcher:
    """Pages from the network, fetched in the workers: only 2xx answers with text, the first ``most`` bytes of each."""

    agent: str = "quillspark/0.1"
    timeout: float = 10.0
    most: int = 2 * 1024 * 1024
    open: Callable = _open

    def one(self, url: str) -> tuple[str | None, str | None]:
        """(html, error)."""
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": "text/html,application/xhtml+xml,text/plain;q=0.9,*/*;q=0.1"})
        try:
            with self.open(request, self.timeout) as answer:
                status, kind = answer.status, (answer.headers.get("Content-Type") or "").lower()
                if not 200 <= status < 300:
                    return None, f"HTTP status {status}"
                if kind and not any(k in kind for k in KINDS):
                    return None, f"unsupported content type: {kind}"
                return answer.read(self.most).decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            return None, f"HTTP status {e.code}"
        except Exception as e:  # a page that can't be had is a row with an error, not a failed job
            return None, str(e) or type(e).__name__

    def fetch(self, urls: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                got = [self.one(u) for u in p["url"]]
                yield pd.DataFrame({"url": p["url"], "html": [g[0] for g in got], "error": [g[1] for g in got]}, dtype=object)

        return urls.select("url").mapInPandas(run, FETCHED)
