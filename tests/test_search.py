import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import snippet, text
from quillspark.operators import boolean, crawl, evaluate, hybrid, index, ranking, robots, suggest, vectors
from quillspark.sources import cranfield, index_store, pages

DOCS = [(0, "The quick brown fox jumps over the lazy dog", "a"), (1, "Quick brown foxes are fast animals", "a"), (2, "Lazy dogs sleep all day in the warm sun", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def idx(docs):
    return index.Index.build(docs, index.fields(docs))


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("sensibiliti", "sensibl"), ("generalizations", "gener"), ("to", "to"), ("42", "42")])
def test_stems(word, stem):
    assert text.stem(word) == stem


def test_tokens(spark):
    t = "They're sure 3.1415 is O'Connor's. Check https://a.org/s?q=rust. now é日本"
    row = spark.createDataFrame([(t,)], "t string").select(text.tokens(F.col("t")).alias("x"), text.byte_spans("t").alias("b")).first()
    assert row.x == ["They're", "sure", "3.1415", "is", "O'Connor's", "Check", "https://a.org/s?q=rust", "now", "é日本"]
    assert [t.encode()[b.start : b.end].decode() for b in row.b] == row.x and [b.position for b in row.b] == list(range(9))
    assert text.analyze("Foxes https://A.org/Cats") == ["fox", "https://A.org/Cats"]


def test_codes(spark):
    assert [text.osa(*p) for p in (("ca", "abc"), ("searh", "search"), ("ab", "ba"), ("", "x"))] == [3, 1, 1, 1]
    for n in (0, 1, 127, 128, 16383, 16384, 2**32 - 1):
        assert text.unvbyte(text.vbyte(n)) == [n]
    with pytest.raises(ValueError):
        text.unvbyte(b"\x01")
    ids = [3, 7, 7 + 128, 100000]
    assert text.unpack(text.pack(ids)) == ids and text.unpack(b"") == []
    r = spark.createDataFrame([(ids,)], "v array<int>").select(text.packed_size(F.col("v")).alias("n"), text.gaps(F.col("v")).alias("g"), text.ungap(text.gaps(F.col("v"))).alias("u")).first()
    assert r.n == len(text.pack(ids)) and r.g[1] == 4 and r.u == ids
    big, at = [], 0
    for k in range(10_000):
        at += 1 + k % 5
        big.append(at)
    assert len(text.pack(big)) < 0.3 * 4 * len(big)


def test_percent_decoding():
    assert text.percent_decode("a+b%20c%zz%e9") == "a b c%�" and text.query_params("q=a+b&k=3&q=%C3%A9&x") == {"q": "é", "k": "3", "x": ""} and text.query_params("") == {}
    assert text.fnv1a(b"") == 0xCBF29CE484222325 and text.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def _ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize("query,ids", [("fox", [0, 1]), ("quick AND lazy", [0]), ("quick AND sleep", []), ("fox OR sun", [0, 1, 2]), ('"quick brown"', [0, 1]), ('"quick fox"', []), ("qui*", [0, 1]), ("NOT foxes", [2]), ("(fox OR sun) AND NOT lazy", [1]), ("quick !lazy", [1]), ("quick && -lazy", [1]), ("nothing", []), ("???", [])])
def test_boolean(idx, query, ids):
    assert _ids(boolean.run(query, idx)) == ids


@pytest.mark.parametrize("query,kind", [("", "empty"), ('"open', "quote"), ("(a", "parenthesis"), ("AND a", "token"), ("a)", "token"), ("a AND", "end")])
def test_bad_queries(query, kind):
    with pytest.raises(boolean.QueryError) as e:
        boolean.parse(query)
    assert e.value.kind == kind


def test_set_operations(idx):
    a, b = idx.get_postings("quick"), idx.get_postings("lazi")
    assert (_ids(boolean.intersect(a, b)), _ids(boolean.union(a, b)), _ids(boolean.difference(a, b))) == ([0], [0, 1, 2], [1])


def test_bm25(spark, idx):
    q = ranking.query_terms(spark.createDataFrame([(1, "quick Quick")], "query_id int, text string"))
    got = {r.doc_id: r.score for r in ranking.bm25(idx, q).collect()}
    avg = (9 + 6 + 9) / 3
    want = {d: math.log((3 - 2 + 0.5) / 2.5 + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / avg)) for d, n in ((0, 9), (1, 6))}
    assert got == pytest.approx(want)
    mixed = ranking.with_pagerank(ranking.bm25(idx, q), spark.createDataFrame([(1, 0.5)], "doc_id long, pagerank double"))
    assert {r.doc_id: r.score for r in mixed.collect()} == pytest.approx({0: want[0], 1: want[1] + math.log1p(50)})


def test_bm25f(spark):
    d = spark.createDataFrame([(0, "license", "the text of a license", ""), (1, "other", "a license here", "license license"), (2, "none", "nothing at all", "")], "doc_id long, title string, body string, anchor string")
    i = index.Index.build(d.select("doc_id", F.concat_ws(" ", "title", "body").alias("text")), index.split_fields(d))
    q = ranking.query_terms(spark.createDataFrame([(1, "licenses")], "query_id int, text string"))
    got = {r.doc_id: r.score for r in ranking.bm25f(i, q).collect()}
    idf = math.log((3 - 2 + 0.5) / 2.5 + 1)
    x0 = 4.0 / (0.5 + 0.5) + 1 / (0.25 + 0.75 * 5 / (11 / 3))
    x1 = 1 / (0.25 + 0.75 * 3 / (11 / 3)) + 2.5 * 2 / (0.4 + 0.6)
    assert got == pytest.approx({0: idf * x0 * 2.2 / (1.2 + x0), 1: idf * x1 * 2.2 / (1.2 + x1)})
    assert [r.field for r in i.field_stats.orderBy("field").collect()] == ["anchor", "body", "title"] and {r.term: r.df for r in i.document_frequency().collect()}["licens"] == 2


def test_feedback(spark, idx):
    asked = spark.createDataFrame([(1, "fox fox")], "query_id int, text string")
    p = ranking.PrfParams(max_df=1.0, terms=2)
    for expand in (ranking.expand_bm25, ranking.expand_bm25f):
        rows = expand(idx, asked, p).collect()
        own = next(r for r in rows if not r.new)
        new = [r.term for r in rows if r.new]
        assert own.term == "fox" and own.w > 2 and len(new) == 2 and not {"the", "over", "are"} & set(new)
    s = ranking.query_strings(asked, ranking.expand_bm25(idx, asked, p)).first().text
    assert s.startswith("fox fox ") and len(s.split()) == 4


def test_pagerank(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3)], "src long, dst long")
    assert {r.node: round(r.pagerank, 6) for r in ranking.pagerank(e, 20).collect()} == {k: 0.333333 for k in (1, 2, 3)}
    chain = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    got = {r.node: r.pagerank for r in ranking.pagerank(chain).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-9) and got[3] > got[2] > got[1]
    r = {1: 1 / 3, 2: 1 / 3, 3: 1 / 3}
    for _ in range(100):
        loose = r[3]
        r = {1: 0.05 + 0.85 * loose / 3, 2: 0.05 + 0.85 * (r[1] + loose / 3), 3: 0.05 + 0.85 * (r[2] + loose / 3)}
    assert got == pytest.approx(r, abs=1e-5)
    one = spark.createDataFrame([(1,)], "node long")
    assert ranking.pagerank(chain.limit(0), nodes=one).collect()[0].pagerank == 1.0 and ranking.pagerank(chain.limit(0)).count() == 0


def test_append(spark, idx):
    more = idx.append(spark.createDataFrame([(2, "warm fox"), (9, "a fox")], "doc_id long, text string"))
    got = {(r.term, r.doc_id): (r.tf, r.positions) for r in more.postings.filter("term IN ('warm', 'fox')").collect()}
    assert got[("warm", 2)] == (2, [7, 9]) and got[("fox", 2)] == (1, [10]) and got[("fox", 9)] == (1, [1])
    assert {r.doc_id: r.len for r in more.lengths.collect()} == {0: 9, 1: 6, 2: 11, 9: 2}
    a = idx.append_anchors(spark.createDataFrame([(0, "see"), (0, "foxes"), (1, "  ")], "doc_id long, text string"))
    assert {(r.term, r.tf) for r in a.field_postings.filter("field = 'anchor' AND doc_id = 0").collect()} == {("a", 1), ("see", 1), ("fox", 1)}
    assert (index.field_of("Links"), index.field_of("content"), index.field_of("x")) == ("anchor", "body", None)


def test_storage(spark, idx, tmp_path):
    want = sorted(map(str, idx.postings.collect()))
    for k, save in ((1, index_store.save_v1), (2, index_store.save_v2)):
        save(idx, f"{tmp_path}/i{k}")
        back = index_store.load(spark, f"{tmp_path}/i{k}")
        assert sorted(map(str, back.postings.select(*idx.postings.columns).collect())) == want and back.lengths.count() == 3 and back.field_postings.count() == idx.field_postings.count()
    kind = lambda path: pytest.raises(index_store.StorageError, index_store.load, spark, path).value.kind
    assert kind(f"{tmp_path}/none") == "io"
    note = tmp_path / "i1" / "manifest.json"
    (tmp_path / "i1" / ".manifest.json.crc").unlink()
    was = note.read_text()
    for change, want in ((("1", "9"), "counts"), (('"version": 1', '"version": 7'), "version"), (("quillspark index", "other"), "format"), (("{", "["), "format")):
        note.write_text(was.replace('"lengths": 3', '"lengths": 4') if want == "counts" else was.replace(*change))
        assert kind(f"{tmp_path}/i1") == want
    meta = spark.createDataFrame([(1, "u", "t", "b", 0.5)], index_store.META)
    index_store.save_metadata(meta, f"{tmp_path}/m")
    assert index_store.load_metadata(spark, f"{tmp_path}/m").collect() == meta.collect()


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 0.0])], "doc_id long, v array<double>")
    i = vectors.VectorIndex(v, 3)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, q array<double>")
    assert [(r.doc_id, round(r.score, 4)) for r in i.search(q, 3).orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (2, 0.7071)]
    i = i.upsert(v.filter("doc_id = 1").withColumn("v", F.array(F.lit(0.0), F.lit(1.0)))).remove(v.filter("doc_id = 4"))
    assert i.size() == 3 and i.get(1).first().v == [0.0, 1.0, 0.0] and i.clear().size() == 0 and i.search(q, 1).first().doc_id == 2
    many = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("q"))
    assert vectors.knn(v, many, 2).count() == 100 and vectors.knn(v, q.limit(0), 2).count() == 0


def test_embedder():
    import numpy as np

    car, repair, rust = (np.array(vectors.embed(t)) for t in ("automobile repair", "car maintenance and tire puncture repair", "rust memory systems"))
    assert car @ repair > 0.65 and car @ repair > car @ rust + 0.4 and np.linalg.norm(car) == pytest.approx(1, abs=1e-6)
    fly, wing = (np.array(vectors.embed(t)) for t in ("supersonic flutter", "aeroelastic instability of aircraft wings at high mach"))
    assert fly @ wing > 0.6 and fly @ wing > fly @ rust + 0.35 and not any(vectors.embed("")) and len(vectors.embed("x", 8)) == 32


def test_hybrid(spark):
    lex = spark.createDataFrame([(1, 10, 4.0, 1), (1, 11, 2.0, 2)], "query_id int, doc_id long, score double, rank int")
    sem = spark.createDataFrame([(1, 11, 0.5, 1), (1, 12, -0.5, 2)], "query_id int, doc_id long, score double, rank int")
    pr = spark.createDataFrame([(12, 0.2)], "doc_id long, pagerank double")
    run = lambda **k: {r.doc_id: r.score for r in hybrid.fuse(lex, sem, pr, hybrid.HybridParams(**k)).collect()}
    up = 1 + math.log1p(3)
    assert run() == pytest.approx({10: 0.55 / 61, 11: 0.55 / 62 + 0.45 / 61, 12: 0.45 / 62 * up})
    assert run(alpha=0.5, include_pagerank=False) == pytest.approx({10: 0.5 + 0.25, 11: 0.375, 12: 0.5 * -1 + 0.125})
    assert run(mode="lexical") == {10: 4.0, 11: 2.0, 12: 0.0}
    assert [hybrid.parse_mode(x) for x in ("BM25", "vector", "what")] == ["lexical", "semantic", "hybrid"]


def test_grams_and_spelling(spark):
    t = spark.createDataFrame([("The license file. Rights 42 reserved http://x.y a b\nlicense file",)], "text string")
    got = {r.term: r.tf for r in suggest.grams(t, 3).collect()}
    assert got == {"the": 1, "license": 2, "file": 2, "rights": 1, "reserved": 1, "the license": 1, "license file": 2, "the license file": 1}
    c = suggest.from_corpus(spark.createDataFrame([("One. two", "three. four")], "title string, body string"))
    assert {r.term: (r.tf, r.df) for r in c.collect()} == {"one": (3, 1), "two": (3, 1), "one two": (3, 1), "three": (1, 1), "four": (1, 1)}
    v = spark.createDataFrame([("search", 5, 1), ("sear", 9, 1), ("reach", 9, 1)], suggest.COUNTS)
    w = spark.createDataFrame([("saerch",), ("Search",), ("zzzzzz",)], "word string")
    assert {r.word: (r.suggestion, r.distance) for r in suggest.spell(v, w).collect()} == {"saerch": ("search", 1), "search": ("search", 0)}
    q = spark.createDataFrame([(1, "Saerch now"), (2, "search")], "query_id int, text string")
    assert {r.query_id: r.corrected for r in suggest.spell_queries(v, q).collect()} == {1: "search now", 2: None}
    log = suggest.record_queries(spark.createDataFrame([("Search",), (":help",), ("x",)], "text string"))
    m = suggest.merge(v, log)
    assert [(r.term, r.tf) for r in suggest.suggest(m, "SEA", 2).collect()] == [("search", 10), ("sear", 9)] and suggest.suggest(m, "sea", 0).count() == 0
    assert [r.term for r in suggest.find_by_prefix(m, "sea").collect()] == ["sear", "search"] and suggest.contains(m, "reach").first().tf == 9


def test_snippets(spark):
    t = "Intro words here. " * 20 + "The license of the file says all rights reserved. " + "Other words follow. " * 20
    s = snippet.snippet(t, "licenses rights")
    assert s.startswith("... ") and s.endswith(" ...") and "<b>license</b>" in s and "<b>rights</b>" in s and len(s) < 230
    assert snippet.snippet("All rights", "right") == "All <b>rights</b>" and snippet.snippet("  ", "x") == "" and snippet.snippet("abc", "") == "abc"
    assert snippet.snippet("ünï cödé " * 50, "none", 20) == "ünï cödé ünï cödé ..." and snippet.opening("x" * 30, 10) == "x" * 10 + " ..."
    assert snippet.snippet("All rights", "right", tags="ansi") == "All \x1b[1;33mrights\x1b[0m"
    texts = ["short", "word " * 60, "y" * 300, "日本 " * 100]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", snippet.opening_sql(F.col("t"), 40).alias("o"))
    assert all(r.o == snippet.opening(r.t, 40) for r in df.collect())


def test_urls(spark):
    cases = {"HTTP://User@Ex.org:80/a/./b/../c/?b=2&utm_x=1&a=#f": "http://ex.org/a/c/?a&b=2", "ftp://x": None, "https://e.org": "https://e.org/"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", crawl.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == cases
    r = spark.createDataFrame([("http://e.org/a/b", "../c"), ("http://e.org/a/b", "mailto:x"), ("http://e.org/a/b", "?q=1")], "b string, r string").select(crawl.resolve(F.col("b"), F.col("r")).alias("x")).collect()
    assert [x.x for x in r] == ["http://e.org/c", None, "http://e.org/a/b?q=1"]


def test_robots(spark):
    r = robots.Robots.parse("User-agent: A\nUser-agent: bot # both\nDisallow: /p*q$\nAllow: /p\nCrawl-delay: 1.5\n\nUser-agent: *\nDisallow: /\nSitemap: http://s\nbad line\nUser-agent: free\nDisallow:")
    assert [g.agents for g in r.groups] == [["a", "bot"], ["*"], ["free"]] and r.sitemaps == ["http://s"]
    assert [r.allowed("bot/1", p) for p in ("/x", "/p1", "/p1q", "/p1qr", "")] == [True, True, False, True, True]
    assert not r.allowed("zzz", "/x") and r.allowed("free", "/x") and (r.delay("bot"), r.delay("zzz")) == (1.5, None) and robots.Robots.parse("").allowed("a", "/")
    paths = spark.createDataFrame([("/ab",), ("/a.html",), ("/c",)], "path string")
    assert [x.allowed for x in robots.allowed_by(paths, [("disallow", "/a"), ("allow", "/*.html$")]).orderBy("path").collect()] == [True, False, True]
    assert [x.ok for x in paths.select(robots.allowed_udf(F.lit("User-agent: *\nDisallow: /a"), "q", "path").alias("ok")).collect()] == [False, False, True]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate((5, 3, 9, 1))], "query_id int, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 3, 2), (1, 1, 1), (1, 7, 1), (1, 5, 0)], "query_id int, doc_id long, grade int")
    r = evaluate.per_query(ranked, qrels, 3).first()
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert (r.p, r.r, r.rr) == pytest.approx((1 / 3, 1 / 3, 1 / 2)) and r.ap == pytest.approx((1 / 2 + 2 / 4) / 3) and r.ndcg == pytest.approx(3 / math.log2(3) / ideal)
    assert {x.metric: x.value for x in evaluate.suite(ranked, qrels, "eight").collect()}["p3"] == pytest.approx(1 / 3)
    base = evaluate.means(ranked, qrels, 3)
    rows = evaluate.compare(base.withColumn("p", F.lit(0.0)), base).collect()
    assert {x.metric: x.lift for x in rows}["p"] == 100.0 and {x.metric: x.lift for x in rows}["r"] == 0.0 and "| MRR |" in evaluate.table(rows, 3)
    assert evaluate.relevant(qrels).count() == 3 and evaluate.binary(ranked).first().grade == 1


def test_cranfield(spark, tmp_path):
    (tmp_path / "cran.all.1400.xml").write_text("<root><doc>\n<docno> 1 </docno><title>wing\nflow</title><text> a b\n</text></doc><doc><docno>x</docno></doc></root>")
    (tmp_path / "cran.qry.xml").write_text("<top><num> 004 </num><title>\nfirst one\n</title></top><top><num>2</num><title>second</title></top><top><num>1</num><title>third</title></top>")
    (tmp_path / "cranqrel.trec.txt").write_text("1 0 1 2\n1 0 5 0\n  2 0 7 1\nbad\n2 0 x 1\n")
    d, j = cranfield.load(spark, str(tmp_path))
    assert [tuple(r) for r in d.orderBy(F.desc("doc_id")).collect()] == [(1, "wing flow", "a b"), (0, "", "")]
    assert sorted(tuple(r) for r in j.collect()) == [(1, "first one", 1, 2), (2, "second", 7, 1), (3, "third", 1, 2)]


class _Answer:
    def __init__(self, status, kind, body):
        self.status, self.headers, self.body = status, {"Content-Type": kind}, body

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def read(self, most):
        return self.body[:most]


def test_fetchers(spark):
    f = lambda *a: pages.HttpFetcher(open=lambda r, t: _Answer(*a), most=4).one("http://x/")
    assert f(200, "text/html; charset=utf-8", b"abcdef") == ("abcd", None) and f(404, "text/html", b"")[1] == "HTTP status 404" and "content type" in f(200, "image/png", b"")[1]
    assert pages.HttpFetcher(open=lambda r, t: 1 / 0).one("http://x/")[1]
    t = pages.TableFetcher(spark.createDataFrame([("http://A.org", "x")], "url string, html string")).add("http://b.org/1", "y")
    got = t.fetch(spark.createDataFrame([("http://a.org/",), ("http://b.org/1",), ("http://c.org/",)], "url string"))
    assert {r.url: (r.html, r.error) for r in got.collect()} == {"http://a.org/": ("x", None), "http://b.org/1": ("y", None), "http://c.org/": (None, "404 Not Found")}
