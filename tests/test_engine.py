import json

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.engine import Engine, is_boolean
from quillspark.operators import crawl, ranking
from quillspark.operators.crawling import CrawlConfig
from quillspark.operators.crawling import crawl as run_crawl
from quillspark.sources.pages import TableFetcher
from quillspark.streaming.crawl import CrawlStream, Sink, ingest

SITE = {
    "http://a.org/": '<title>Home</title><p>Start page</p><a href="/one">1</a><a href="http://b.org/x">b</a><a href="/private/z">p</a>',
    "http://a.org/one": '<title>One</title>First text about foxes <a href="/">home</a><a href="/missing">m</a>',
    "http://b.org/x": "<title></title>Second site <script>var no = 1</script> &amp; more",
    "http://a.org/robots.txt": "User-agent: *\nDisallow: /private",
    "http://a.org/private/z": "<title>No</title>",
}


@pytest.fixture(scope="module")
def fetcher(spark):
    return TableFetcher(spark.createDataFrame(list(SITE.items()), "url string, html string"))


@pytest.fixture(scope="module")
def demo(spark):
    return Engine.demo(spark)


def test_crawl_waves(spark, fetcher):
    got = run_crawl(spark, fetcher, ["http://a.org", "not a url"])
    rows = {r.doc_id: r for r in got.documents.collect()}
    assert [rows[k].url for k in sorted(rows)] == ["http://a.org/", "http://a.org/one", "http://b.org/x"]
    assert (got.visited, got.failed, got.disallowed, got.discovered) == (3, 1, 1, 4)
    assert {r.doc_id: r.text for r in got.content().collect()}[3] == "Second site & more"
    edges, nodes = ranking.link_graph(got.documents)
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 3), (2, 1)] and nodes.count() == 3
    assert run_crawl(spark, fetcher, ["http://a.org"], CrawlConfig(max_pages=1)).visited == 1


def test_frontier(spark):
    f = crawl.Frontier.empty(spark).push(spark.createDataFrame([("http://a.org/1", 5), ("HTTP://A.org/1#x", 2), ("http://a.org/2", 3), ("http://b.org:81/", 9), ("mailto:x", 1)], "url string, seq long"))
    assert f.seen_count() == f.queue_len() == 3
    assert [(r.host, r.seq) for r in f.pop_polite().orderBy("seq").collect()] == [("a.org", 2), ("b.org:81", 9)]
    f = f.done(f.pop_polite()).push(spark.createDataFrame([("http://a.org/1", 0)], "url string, seq long"))
    assert f.queue_len() == 1 and f.seen_count() == 3 and not f.is_empty()
    assert crawl.next_delay({"a": 1.0}, {"a"}, 1.2) == pytest.approx(0.3) and crawl.next_delay({"a": 1.0}, {"a", "b"}, 1.2) == 0 and crawl.next_delay({}, set(), 0) is None


def test_engine_search(demo):
    top = demo.search("ranking long documents", 3).collect()
    assert top[0].rank == 1 and 2 in [r.doc_id for r in top]
    assert [r.doc_id for r in demo.search("bm25", mode="lexical").collect()] == [2]
    assert demo.search("vehicle repair", 1, mode="semantic").first().doc_id == 5
    assert demo.search("  ").count() == 0
    rows, instead = demo.results("pagerakn", mode="lexical")
    assert instead == "pagerank" and "<b>PageRank</b>" in rows.filter("doc_id = 3").first().snippet
    got = json.loads(demo.search_json("inverted index", 2))
    assert got["total"] == 2 and got["results"][0]["doc_id"] == 1 and got["results"][0]["rank"] == 1 and json.loads(demo.search_json(" "))["results"] == []
    assert json.loads(demo.suggest_json("pos"))["suggestions"][0]["term"] in ("postings", "positions")
    assert json.loads(demo.stats_json())["total_documents"] == 6


def test_engine_commands(demo, tmp_path):
    assert is_boolean("a AND b") and is_boolean("-a") and not is_boolean("a b")
    kinds = {line: demo.run(line)[0] for line in (":help", ":stats", ":docs", ":suggest p", ":query index OR bm25", ":and inverted index", '"inverted index"', "inver*", "inverted OR bm25", "inverted index")}
    assert list(kinds.values()) == ["help", "stats", "docs", "suggest", "boolean", "boolean", "phrase", "prefix", "boolean", "ranked"]
    assert [r.doc_id for r in demo.run('"inverted index"')[1].collect()] == [1] and sorted(r.doc_id for r in demo.run(":or inverted bm25")[1].collect()) == [1, 2]
    assert demo.run(":expand inverted")[1].filter("new").count() > 0 and demo.run(":prf inverted")[1].first().doc_id == 1
    with pytest.raises(ValueError):
        demo.run(":what")
    demo.run(f":save {tmp_path}/s")
    back = demo.run(f":load {tmp_path}/s")[1]
    assert back.stats() == demo.stats() and [r.doc_id for r in back.bm25("bm25").collect()] == [2]
    import shutil

    shutil.rmtree(f"{tmp_path}/s/meta")
    assert Engine.load(demo.spark, f"{tmp_path}/s").meta.orderBy("doc_id").first().title == "Document 0"


def test_engine_changes(spark, demo, fetcher):
    new = spark.createDataFrame([("https://quill.test/bm25", "New title", ""), ("https://quill.test/new", "Fresh", "zebra page")], "url string, title string, body string")
    e = demo.ingest(new)
    rows = {r.url: r for r in e.meta.collect()}
    assert len(rows) == 7 and rows["https://quill.test/bm25"].title == "New title" and rows["https://quill.test/bm25"].body.startswith("BM25") and rows["https://quill.test/new"].doc_id == 6
    assert e.bm25("zebra").first().doc_id == 6
    assert ingest(e.meta.limit(0), new).agg(F.max("doc_id")).first()[0] == 1
    r = e.update_pageranks(spark.createDataFrame([(6, 0.5)], "node long, pagerank double"))
    assert r.meta.filter("doc_id = 6").first().pagerank == 0.5
    made, got = Engine.recrawl(spark, fetcher, ["http://a.org"])
    assert got.visited == 3 and made.meta.agg(F.sum("pagerank")).first()[0] == pytest.approx(1, abs=1e-5)
    assert Engine.recrawl(spark, fetcher, ["http://nowhere.org"])[0] is None
    qrels = spark.createDataFrame([(1, 2, 1)], "query_id int, doc_id long, grade int")
    rows = {x.metric: x for x in demo.evaluate(spark.createDataFrame([(1, "bm25")], "query_id int, text string"), qrels).collect()}
    assert rows["rr"].baseline == rows["rr"].candidate == 1 and rows["rr"].lift == 0


def test_command_line(spark, tmp_path):
    out = []
    spark.createDataFrame(list(SITE.items()), "url string, html string").write.parquet(f"{tmp_path}/pages")
    assert main(["crawl", "http://a.org", "--store", f"{tmp_path}/s", "--pages", f"{tmp_path}/pages"], spark, out=out.append) == 0 and out[-1].startswith("3 pages")
    assert main(["crawl", "http://zz.org", "--store", f"{tmp_path}/t", "--pages", f"{tmp_path}/pages"], spark, out=out.append) == 1
    main(["search", "foxes", "--store", f"{tmp_path}/s"], spark, out=out.append)
    assert "One" in out[-1] and "\x1b[1;33mfoxes" in out[-1]
    main(["search", "foxes", "--store", f"{tmp_path}/s", "--json", "--mode", "lexical"], spark, out=out.append)
    assert json.loads(out[-1])["total"] == 1
    main(["ask"], spark, lines=[":stats", "", "inverted AND", "inverted index", ":quit", "never"], out=out.append)
    assert any("error" in x for x in out) and "doc_id=1" in "".join(out)


def test_stream(spark, tmp_path):
    calls = []

    class Seen(Sink):
        def on_documents(self, pages):
            calls.append(("docs", pages.count()))

        def on_pagerank(self, ranks):
            calls.append(("ranks", ranks.count()))

    rows = [(k, u, h) for k, (u, h) in enumerate(SITE.items()) if "robots" not in u and "private" not in u]
    s = CrawlStream(spark, f"{tmp_path}/in", f"{tmp_path}/store", rank_every=2, sink=Seen())
    s.enqueue(spark.createDataFrame(rows[:2] + [(9, "HTTP://A.org", "again"), (10, "bad", "x"), (11, "http://c.org", None)], "page_id long, url string, html string"))
    s.start(once=True).wait()
    assert s.telemetry.pages == 2 and ("ranks", 2) in calls and json.loads(s.telemetry.to_json())["pages"] == 2
    s.enqueue(spark.createDataFrame(rows, "page_id long, url string, html string"))
    s.resume(once=True).wait()
    got = {r.url: r for r in s.store.metadata().collect()}
    assert sorted(got) == sorted(u for _, u, _ in rows) and sorted(r.doc_id for r in got.values()) == [0, 1, 2]
    s.stop()
    assert s.telemetry.state == "stopped" and s.store.ranks().agg(F.sum("pagerank")).first()[0] == pytest.approx(1, abs=1e-6)
    q = ranking.query_terms(spark.createDataFrame([(1, "fox")], "query_id int, text string"))
    assert ranking.bm25(s.store.index(), q).count() == 1
    few = CrawlStream(spark, f"{tmp_path}/in", f"{tmp_path}/few", max_pages=1)
    few.start(once=True).wait()
    assert few.store.pages().count() == 1
