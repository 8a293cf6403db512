"""Command line: crawl pages into a store, search it, ask it line by line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .operators.crawling import CrawlConfig
from .sources.pages import HttpFetcher, TableFetcher


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="crawl from seeds, rank, save")
    c.add_argument("seeds", nargs="+")
    c.add_argument("--store", required=True)
    c.add_argument("--max-pages", type=int, default=100)
    c.add_argument("--pages", help="a Parquet table (url, html) instead of the network")
    c.add_argument("--no-robots", action="store_true")
    s = sub.add_parser("search", help="search a store, or the demo")
    s.add_argument("query")
    s.add_argument("--store")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("--alpha", type=float)
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--prf", action="store_true")
    s.add_argument("--json", action="store_true")
    i = sub.add_parser("ask", help="read commands and queries from standard input")
    i.add_argument("--store")
    return p


def render(rows: list) -> str:
    """Results as text: rank, title, score, address, snippet."""
    out = []
    for r in rows:
        d = r.asDict()
        out.append(f"{d.get('rank', '-')}. {d.get('title', d.get('doc_id'))}  score {d.get('score', 0):.4f}  pagerank {d.get('pagerank', 0):.4f}\n   {d.get('url', '')}\n   {d.get('snippet', '')}")
    return "\n".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, lines=None, out=print) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    if a.command == "crawl":
        fetcher = TableFetcher(spark.read.parquet(a.pages)) if a.pages else HttpFetcher()
        engine, got = Engine.recrawl(spark, fetcher, a.seeds, CrawlConfig(a.max_pages, not a.no_robots))
        if engine is None:
            out("no page could be read")
            return 1
        engine.save(a.store)
        out(f"{got.visited} pages, {got.failed} failed, {got.disallowed} disallowed, {got.discovered} links, {got.waves} waves")
        return 0
    engine = Engine.load(spark, a.store) if a.store else Engine.demo(spark)
    if a.command == "search":
        if a.json:
            out(engine.search_json(a.query, a.k, a.mode, a.alpha))
        elif a.prf:
            for r in engine.prf(a.query, a.k).collect():
                out(f"{r.rank}. {r.doc_id}  score {r.score:.4f}")
        else:
            rows, instead = engine.results(a.query, a.k, a.mode, a.alpha, tags="ansi", most=160)
            if instead:
                out(f"did you mean: {instead}")
            out(render(rows.collect()))
        return 0
    for line in lines if lines is not None else sys.stdin:
        if line.strip() in (":quit", ":exit"):
            break
        if not line.strip():
            continue
        try:
            kind, got = engine.run(line)
        except ValueError as e:
            out(f"error: {e}")
            continue
        if isinstance(got, Engine):
            engine = got
            out("loaded")
        elif isinstance(got, DataFrame):
            for r in got.limit(50).collect():
                out("  ".join(f"{k}={v}" for k, v in r.asDict().items()))
        else:
            out(str(got))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
