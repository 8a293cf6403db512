"""The registered search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.snippet import opening_sql, snippet_udf
from ..functions.text import byte_rows, packed_size, pack_udf, percent_decode_udf, stop_stems, ungap, unpack_udf
from ..operators import boolean, crawl, evaluate, hybrid, index, ranking, robots, suggest, vectors
from ..operators.crawling import CrawlConfig
from ..operators.crawling import crawl as crawl_waves
from ..sources.pages import TableFetcher
from ..sources.shared import saved
from ..streaming.crawl import ingest, update_pageranks
from . import sql

PREFIX, WORDS, FEEDBACK = "tio", ["the", "licenses", "tions"], ["licensed", "rights", "reserved"]
ROBOTS = [("disallow", "/a"), ("allow", "/a*e"), ("disallow", "/*.html$"), ("disallow", "/t")]
_BUILT: dict[tuple, index.Index] = {}


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text", "source")


def built(spark, d) -> index.Index:
    """The index of the documents of a folder, built in one pass and stored once in an application, sorted by term within ranges of terms."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        docs = _docs(spark, d)
        _BUILT[key] = index.Index.stored(saved(index.term_table(docs)), docs)
    return _BUILT[key]


def _queries(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"))


def _edges(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _pages(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", "html")


def _round(df, *cols, n=6):
    return df.select([F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def _top(df, k, n=9, out=6):
    return _round(ranking.top(_round(df, "score", n=n), k), "score", n=out)


def _bool(query):
    return lambda s, d: boolean.run(query, built(s, d))


def _one(s, words):
    return s.createDataFrame([(1, " ".join(words))], "query_id int, text string")


def _bm25(s, d, words):
    return ranking.bm25(built(s, d), ranking.query_terms(_one(s, words)))


def _bm25f(s, d, words=None, **kw):
    return ranking.bm25f(built(s, d), ranking.query_terms(_one(s, words or WORDS)), **kw)


def _ranks(s, d):
    """A rank of each document that SQL can make too."""
    return _docs(s, d).select("doc_id", (1.0 / (1 + F.col("doc_id"))).alias("pagerank"))


def _weighted(s):
    return s.createDataFrame([(1, "licens", 2.0), (1, "right", 0.5), (1, "the", -1.0)], "query_id int, term string, w double")


def _qrels(s, d):
    return _t(s, d, "labels").select(F.lit(1).alias("query_id"), "doc_id", F.col("quality").alias("grade"))


def _ranked(s, d, words=("the", "of", "tions")):
    return saved(ranking.top(_round(_bm25(s, d, words), "score", n=9), 100))


def _compared(s, d, ranked):
    """The ranking beside itself with ranks mixed in."""
    mixed = ranking.top(ranking.with_pagerank(ranked.drop("rank"), _ranks(s, d)), 100)
    return evaluate.compare(evaluate.means(ranked, _qrels(s, d), 10), evaluate.means(mixed, _qrels(s, d), 10))


def _hosts(s, d):
    return _pages(s, d).select("page_id", crawl.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


def _nearest(s, d, where, k):
    q = _vectors(s, d).filter(where).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.knn(_vectors(s, d), q, k)


def _channels(s, d, words=None):
    """The candidates of both channels: BM25F of the words, neighbours of vector 0."""
    lex = saved(ranking.top(_round(_bm25f(s, d, words), "score", n=9), 60))
    sem = _nearest(s, d, "doc_id = 0", 60).select(F.lit(1).alias("query_id"), "doc_id", "score", "rank")
    return lex, sem


def _hybrid(ranks=False, **kw):
    def run(s, d):
        p = hybrid.HybridParams(**kw)
        lex, sem = _channels(s, d)
        out = hybrid.fuse(lex if p.mode != "semantic" else None, sem if p.mode != "lexical" else None, _ranks(s, d) if ranks else None, p)
        return _round(out.select("query_id", "doc_id", "score"), "score")

    return run


def _texts(s, d):
    return _docs(s, d).select("text")


def _split(s, d):
    first = F.substring_index("text", "\n", 1)
    return _docs(s, d).select(first.alias("title"), F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("body"))


def _log(s, d):
    return _t(s, d, "conversations").filter("role = 'user'").select("text")


def _expanded(s, d):
    return ranking.expand_bm25(built(s, d), _one(s, FEEDBACK))


def _expanded_f(s, d):
    return ranking.expand_bm25f(built(s, d), _one(s, FEEDBACK))


def _typed(s):
    return s.createDataFrame([(w,) for w in ("licnese", "rigths", "resreved", "verison", "tihs", "the", "xqzzkw")], "word string")


def _graph(s, d):
    p = _pages(s, d).select(F.col("page_id").alias("doc_id"), crawl.normalize_url(F.col("url")).alias("url"), crawl.page_fields(F.col("url"), F.col("html"))[2])
    return ranking.link_graph(p)


def _crawled(s, d):
    pages = _pages(s, d)
    seeds = [r.url for r in pages.orderBy("page_id").limit(3).collect()]
    return crawl_waves(s, TableFetcher(pages), seeds, CrawlConfig(max_pages=20))


def _meta(s, d):
    return _pages(s, d).filter("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("doc_id")).select("doc_id", "url", F.lit("old").alias("title"), F.lit("text").alias("body"), F.lit(0.5).alias("pagerank"))


def queries():
    q = {
        "doc_lengths": lambda s, d: built(s, d).lengths,
        "build_postings": lambda s, d: built(s, d).postings.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")),
        "field_stats": lambda s, d: _round(built(s, d).field_stats, "avg_len"),
        "field_postings": lambda s, d: built(s, d).field_postings,
        "term_df_any_field": lambda s, d: built(s, d).document_frequency(),
        "idf_table": lambda s, d: _round(built(s, d).vocabulary.crossJoin(F.broadcast(built(s, d).stats)).select("term", "df", ranking.idf(F.col("n"), F.col("df")).alias("idf")), "idf"),
        "index_stats": lambda s, d: built(s, d).vocabulary.agg(F.count("*").alias("vocabulary"), F.sum("tf").alias("total_terms"), F.sum("df").alias("n_postings")),
        "trie_from_index": lambda s, d: built(s, d).vocabulary,
        "postings_deltas": lambda s, d: index.deltas(built(s, d).frequencies),
        "postings_vbyte_size": lambda s, d: built(s, d).postings.select("term", "doc_id", packed_size(F.col("positions")).alias("bytes")),
        "postings_vbyte_round_trip": lambda s, d: built(s, d).postings.select("term", "doc_id", "positions", pack_udf("positions").alias("p")).select("term", "doc_id", F.length("p").cast("long").alias("bytes"), (unpack_udf("p") == F.col("positions")).alias("same")),
        "gap_decode": lambda s, d: built(s, d).postings.filter("term = 'licens'").select("doc_id", F.array_join(F.transform(ungap(F.transform("positions", lambda p, i: p - F.coalesce(F.get("positions", i - 1), F.lit(0)))), lambda x: x.cast("string")), ",").alias("positions")),
        "append_positions": lambda s, d: index.Index(built(s, d).postings.filter("term = 'the'"), built(s, d).lengths).append(_docs(s, d).select("doc_id", F.lit("then the end").alias("text"))).postings.filter("term = 'the'").select("doc_id", "tf", F.element_at("positions", -1).cast("long").alias("last")),
        "append_anchors": lambda s, d: built(s, d).append_anchors(_docs(s, d).select("doc_id", F.lit("inbound license").alias("text"))).field_postings.filter("field = 'anchor' AND term IN ('licens', 'inbound')").select("term", "doc_id", "tf"),
        "token_offsets": lambda s, d: byte_rows(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.max("end").cast("long").alias("last_end")),
        "analyze_stems": lambda s, d: built(s, d).vocabulary.select("term", "tf"),
        "stop_words": lambda s, d: s.createDataFrame([(w,) for w in stop_stems()], "term string"),
        "search_term": _bool("licenses"), "bool_and": _bool("the AND tions"), "bool_or": _bool("licenses OR reserved"), "bool_and_not": _bool("the AND NOT tions"),
        "bool_pure_not": _bool("NOT the"), "bool_query_nested": _bool("(license || reserved) -tions"), "prefix_search": _bool(PREFIX + "*"), "phrase_search": _bool('"of the"'),
        "bool_phrase_prefix": _bool(f'"of the" && (licens* OR {PREFIX}*) !reserved'),
        "postings_intersect": lambda s, d: boolean.intersect(built(s, d).get_postings("the"), built(s, d).get_postings("tion")).select("doc_id", "tf"),
        "postings_union": lambda s, d: boolean.union(built(s, d).get_postings("licens"), built(s, d).get_postings("reserv")).select("term", "doc_id", "tf"),
        "postings_difference": lambda s, d: boolean.difference(built(s, d).get_postings("the"), built(s, d).get_postings("tion")).select("doc_id", "tf"),
        "bm25_topk": lambda s, d: _top(_bm25(s, d, WORDS), 10),
        "bm25_weighted": lambda s, d: _top(ranking.bm25(built(s, d), _weighted(s)), 10),
        "bm25_batch": lambda s, d: _top(ranking.bm25(built(s, d), ranking.query_terms(_queries(s, d))), 3, 7, 3),
        "bm25_pagerank": lambda s, d: _top(ranking.with_pagerank(_bm25(s, d, WORDS), _ranks(s, d)), 10),
        "bm25f_topk": lambda s, d: _top(_bm25f(s, d), 10),
        "bm25f_no_title": lambda s, d: _top(_bm25f(s, d, params={**ranking.FIELD_PARAMS, "title": (0.0, 0.5)}), 10),
        "bm25f_pagerank": lambda s, d: _top(ranking.with_pagerank(_bm25f(s, d), _ranks(s, d)), 10),
        "prf_expansion_terms": lambda s, d: _round(_expanded(s, d).select("term", "w"), "w"),
        "prf_query_string": lambda s, d: ranking.query_strings(_one(s, FEEDBACK), _expanded(s, d)),
        "bm25_prf": lambda s, d: _top(ranking.bm25(built(s, d), _expanded(s, d)), 10, 7, 5),
        "bm25f_prf_terms": lambda s, d: _round(_expanded_f(s, d).select("term", "w"), "w"),
        "bm25f_prf": lambda s, d: _top(ranking.bm25f(built(s, d), _expanded_f(s, d)), 10, 7, 5),
        "graph_degrees": lambda s, d: ranking.degrees(_edges(s, d)).select("node", "out_degree", "in_degree"),
        "graph_neighbors": lambda s, d: ranking.degrees(_edges(s, d)).select("node", F.array_join("out_neighbors", ",").alias("out"), F.array_join("in_neighbors", ",").alias("in_")),
        "graph_stats": lambda s, d: _edges(s, d).filter("src <> dst").distinct().agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst")),
        "link_graph": lambda s, d: _graph(s, d)[0],
        "pagerank_k_iter": lambda s, d: _round(ranking.pagerank(_edges(s, d), 3, tol=0.0), "pagerank", n=9),
        "pagerank_converged": lambda s, d: _round(ranking.pagerank(_edges(s, d)), "pagerank", n=6),
        "vec_norm": lambda s, d: _round(_vectors(s, d).select("doc_id", vectors.norm("v").alias("norm")), "norm"),
        "vec_normalize": lambda s, d: _round(_vectors(s, d).select("doc_id", vectors.normalize("v").alias("v")).select("doc_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")), "total"),
        "vec_upsert": lambda s, d: vectors.VectorIndex(_vectors(s, d), 16).remove(_vectors(s, d).filter("doc_id % 10 = 0")).upsert(_vectors(s, d).filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") - 100)).vectors.select("doc_id", F.size("v").cast("long").alias("dimension")),
        "knn_single": lambda s, d: _round(_nearest(s, d, "doc_id = 7", 10), "score"),
        "knn_batch": lambda s, d: _round(_nearest(s, d, "doc_id % 100 = 0", 5), "score"),
        "embed_documents": lambda s, d: _docs(s, d).select("doc_id", vectors.embed_udf("text").alias("v")).select("doc_id", F.size("v").alias("dimension"), F.round(vectors.norm("v"), 4).alias("norm")),
        "hybrid_rrf": _hybrid(), "hybrid_linear": _hybrid(alpha=0.5), "hybrid_rrf_pagerank": _hybrid(ranks=True), "hybrid_lexical_mode": _hybrid(mode="lexical"), "hybrid_semantic_mode": _hybrid(mode="semantic"),
        "ngram_counts": lambda s, d: suggest.grams(_texts(s, d), 3),
        "ngram_title_weighted": lambda s, d: suggest.from_corpus(_split(s, d)),
        "suggest_topk": lambda s, d: suggest.suggest(built(s, d).vocabulary, "th", 8),
        "suggest_with_query_log": lambda s, d: suggest.suggest(suggest.merge(built(s, d).vocabulary, suggest.record_queries(_log(s, d))), "wh", 8),
        "prefix_terms": lambda s, d: suggest.find_by_prefix(built(s, d).vocabulary, PREFIX).select("term"),
        "term_frequency": lambda s, d: suggest.contains(built(s, d).vocabulary, " Licens "),
        "spell_vocab": lambda s, d: suggest.grams(_texts(s, d), 1).select("term", "tf"),
        "spell_suggest": lambda s, d: suggest.spell(suggest.grams(_texts(s, d), 1), _typed(s)),
        "spell_query": lambda s, d: suggest.spell_queries(suggest.grams(_texts(s, d), 1), s.createDataFrame([(1, "licnese of rigths"), (2, "the license")], "query_id int, text string")),
        "snippets_topk": lambda s, d: ranking.top(_bm25(s, d, FEEDBACK), 10).join(_docs(s, d), "doc_id").select("doc_id", snippet_udf("text", " ".join(FEEDBACK)).alias("snippet")),
        "snippet_fallback": lambda s, d: _docs(s, d).select("doc_id", opening_sql(F.col("text"), 160).alias("opening")),
        "percent_decode": lambda s, d: _pages(s, d).select("page_id", percent_decode_udf(F.concat(F.lit("a+b%20c%2F"), F.col("page_id").cast("string"))).alias("decoded")),
        "url_parts": _hosts,
        "normalize_urls": lambda s, d: _pages(s, d).select("page_id", crawl.normalize_url(F.col("url")).alias("url")),
        "host_counts": lambda s, d: _hosts(s, d).groupBy("host").agg(F.count("*").alias("n")),
        "page_titles": lambda s, d: _pages(s, d).select("page_id", crawl.title(F.col("html")).alias("title")),
        "page_text_len": lambda s, d: _pages(s, d).select("page_id", F.length(crawl.visible_text(F.col("html"))).alias("n")),
        "resolved_links": lambda s, d: _pages(s, d).select("page_id", "url", F.explode(crawl.links(F.col("html"))).alias("href")).select("page_id", crawl.resolve(F.col("url"), F.col("href")).alias("target")),
        "robots_allowed": lambda s, d: robots.allowed_by(_hosts(s, d).select("page_id", "path"), ROBOTS),
        "robots_agents": lambda s, d: _hosts(s, d).select("page_id", robots.allowed_udf(F.lit("User-agent: quill\nUser-agent: b\nDisallow: /a\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /"), "quillbot", "path").alias("allowed")),
        "frontier_schedule": lambda s, d: crawl.schedule(_hosts(s, d).select("host", F.col("page_id").alias("seq"))).select("wave", "host", "seq"),
        "frontier_push": lambda s, d: crawl.Frontier.empty(s).push(_pages(s, d).select("url", F.col("page_id").alias("seq"))).pop_polite().select("host", "seq"),
        "crawl_waves": lambda s, d: _crawled(s, d).documents.select("doc_id", "url", "title", F.size("links").alias("n_links")),
        "incremental_ingest_stats": lambda s, d: ingest(_meta(s, d), _pages(s, d).select("url", F.lit("new").alias("title"), F.lit("").alias("body"))).groupBy("title", "body", "pagerank").agg(F.count("*").alias("n")),
        "update_pageranks": lambda s, d: update_pageranks(_meta(s, d), _meta(s, d).filter("doc_id % 4 = 0").select(F.col("doc_id").alias("node"), F.lit(0.25).alias("pagerank"))).select("doc_id", "pagerank"),
        "eval_metrics": lambda s, d: _round(evaluate.per_query(_ranked(s, d), _qrels(s, d), 10), "p", "r", "rr", "ap", "ndcg"),
        "eval_suite": lambda s, d: _round(evaluate.suite(_ranked(s, d), _qrels(s, d)), "value"),
        "eval_compare_lift": lambda s, d: _round(_compared(s, d, _ranked(s, d)), "baseline", "candidate", "lift"),
    }
    return q


def _has(term):
    return f"bool_or(term = '{term}')"


def _hit(having):
    return f"SELECT doc_id FROM rows GROUP BY 1 HAVING {having}"


def _prf_sql(first, score, df):
    """x(term, w, isnew) by feedback from the best five documents of sc; ``score`` is the sum over fields or texts of one term and document."""
    return (f"best AS MATERIALIZED (SELECT doc_id FROM ({sql.top(5)})), stop AS (SELECT DISTINCT term FROM stems JOIN ({sql.stop_terms()}) USING (t)), "
            f"fb AS MATERIALIZED (SELECT term, sum(0.5 / (SELECT count(*) FROM best) * {sql.idf('df')} * part) AS fb FROM ({score}) JOIN {df} USING (term) "
            f"WHERE strlen(term) >= 3 AND term NOT IN (SELECT term FROM stop) AND df <= 0.4 * {sql.N} GROUP BY 1), own AS (SELECT term, count(*)::DOUBLE AS w FROM asked JOIN stems USING (t) GROUP BY 1), "
            "x AS MATERIALIZED (SELECT own.term, own.w + coalesce(fb.fb, 0) AS w, false AS isnew FROM own LEFT JOIN fb USING (term) UNION ALL "
            "SELECT term, fb, true FROM (SELECT term, fb, row_number() OVER (ORDER BY round(fb, 9) DESC, term) AS rn FROM fb WHERE term NOT IN (SELECT term FROM own)) WHERE rn <= 5)")


_PART = "SELECT term, tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * lens.len / (SELECT avg(len) FROM lens))) AS part FROM tf JOIN best USING (doc_id) JOIN lens USING (doc_id)"
_PART_F = "SELECT term, x * 2.2 / (1.2 + x) AS part FROM soft JOIN best USING (doc_id)"
_STOPS = "SELECT t FROM asked UNION ALL " + sql.stop_terms()


def _prf_bm25():
    return f"asked AS ({sql.listed(FEEDBACK)}), {sql.voc(_STOPS)}, wanted AS (SELECT DISTINCT query_id, term, w FROM asked JOIN stems USING (t)), {sql.score()}, {_prf_sql('tf', _PART, 'voc')}"


def _prf_bm25f():
    return f"asked AS ({sql.listed(FEEDBACK)}), {sql.field_tf(_STOPS)}, wanted AS (SELECT DISTINCT query_id, term, w FROM asked JOIN stems USING (t)), {sql.score_f()}, {_prf_sql('soft', _PART_F, 'fdf')}"


def _mixed(src="sc"):
    return f"mixed AS (SELECT query_id, doc_id, score + ln(1 + 100.0 * (1.0 / (1 + doc_id))) AS score FROM {src})"


def _fused(score, join="FULL JOIN"):
    ch = f"lex AS MATERIALIZED ({sql.top(60, out=9)}), sem AS MATERIALIZED (SELECT 1 AS query_id, doc_id, score, rank FROM kt WHERE rank <= 60)"
    return f"WITH {sql.bm25f(sql.listed(WORDS))}, {sql.neighbours('q.vec_id = 0')}, {ch} SELECT 1 AS query_id, coalesce(lex.doc_id, sem.doc_id) AS doc_id, round({score}, 6) AS score FROM lex {join} sem ON lex.doc_id = sem.doc_id"


_RRF = "(coalesce(0.55 / (60 + lex.rank), 0) + coalesce(0.45 / (60 + sem.rank), 0))"
_PATH = "regexp_extract(regexp_replace(trim(url), '#.*$', ''), '(?i)^https?://(?:[^/@]*@)?[^/:?]*(?::[0-9]+)?([^?]*)', 1)"
_HOST = "lower(regexp_extract(url, '(?i)^https?://(?:[^/@]*@)?([^/:?]*)', 1))"
_ENT = "replace(replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ')"
_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def _eval_sql(src, k=10):
    """m(p, r, rr, ap, ndcg) of the ranking ``src`` (doc_id, rank)."""
    return (f"(SELECT coalesce(sum(CASE WHEN rank <= {k} THEN 1 END) / {k}.0, 0) AS p, coalesce(sum(CASE WHEN rank <= {k} THEN 1 END) / (SELECT count(*) FROM rel)::DOUBLE, 0) AS r, coalesce(1.0 / min(rank), 0) AS rr, "
            f"coalesce(sum(nth / rank::DOUBLE) / (SELECT count(*) FROM rel), 0) AS ap, coalesce(sum(CASE WHEN rank <= {k} THEN (pow(2, grade) - 1) / log2(rank + 1) END) / (SELECT sum((pow(2, grade) - 1) / log2(i + 1)) FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, doc_id) AS i FROM rel) WHERE i <= {k}), 0) AS ndcg "
            f"FROM (SELECT rank, grade, row_number() OVER (ORDER BY rank) AS nth FROM {src} JOIN rel USING (doc_id)))")


def oracle_sql():
    rows = f"WITH {sql.rows()} "
    edges = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"
    nodes = f"{edges}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), deg AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT node, 1.0 / n AS pr FROM nodes, c)"
    for k in range(1, 31):
        nodes += (f", r{k} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(pr), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM deg)) / n) AS pr "
                  f"FROM nodes CROSS JOIN c LEFT JOIN (SELECT e.dst, sum(p.pr / deg.deg) AS s FROM e JOIN deg USING (src) JOIN r{k - 1} p ON p.node = e.src GROUP BY 1) g ON g.dst = nodes.node)")
    ranked = f"asked AS ({sql.listed(['the', 'of', 'tions'])}), {sql.voc('SELECT t FROM asked')}, wanted AS (SELECT DISTINCT query_id, term, w FROM asked JOIN stems USING (t)), {sql.score()}, rel AS (SELECT doc_id, quality AS grade FROM labels WHERE quality > 0), rk AS MATERIALIZED ({sql.top(100, out=9)})"
    meta = "meta AS (SELECT min(page_id) AS doc_id, url FROM pages WHERE page_id % 2 = 0 GROUP BY url)"
    both = "coalesce(a.{0}, b.{0})"
    vbytes = "list_sum(list_transform(range(1, len(ps) + 1), lambda i: greatest(1, ceil(length(bin(ps[i] - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END)) / 7.0))))::BIGINT"
    spell = (f"voc AS MATERIALIZED (SELECT * FROM {sql.grams('text', 'documents', 1, 1)}), typed AS (SELECT unnest(['licnese', 'rigths', 'resreved', 'verison', 'tihs', 'the', 'xqzzkw']) AS word), "
             "near AS (SELECT word, term, tf, damerau_levenshtein(word, term) AS distance FROM typed JOIN voc ON abs(strlen(word) - strlen(term)) <= 2)")
    return {
        "doc_lengths": f"SELECT doc_id, len({sql.terms('text')}) AS len FROM documents",
        "build_postings": rows + "SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM rows GROUP BY 1, 2",
        "field_stats": f"WITH {sql.field_tf()} SELECT field, count(*) AS n_docs, round(avg(len), 6) AS avg_len FROM flens GROUP BY 1",
        "field_postings": f"WITH {sql.field_tf()} SELECT field, term, doc_id, tf FROM ftf",
        "term_df_any_field": f"WITH {sql.field_tf()} SELECT term, count(DISTINCT doc_id) AS df FROM ftf GROUP BY 1",
        "idf_table": f"WITH {sql.voc()} SELECT term, df, round({sql.idf('df')}, 6) AS idf FROM voc",
        "index_stats": f"WITH {sql.voc()} SELECT count(*) AS vocabulary, sum(tf)::BIGINT AS total_terms, sum(df)::BIGINT AS n_postings FROM voc",
        "trie_from_index": f"WITH {sql.voc()} SELECT term, tf, df FROM voc",
        "postings_deltas": f"WITH {sql.tf()} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM tf",
        "postings_vbyte_size": rows + f"SELECT term, doc_id, {vbytes} AS bytes FROM (SELECT term, doc_id, list(pos ORDER BY pos) AS ps FROM rows GROUP BY 1, 2)",
        "postings_vbyte_round_trip": rows + f"SELECT term, doc_id, {vbytes} AS bytes, true AS same FROM (SELECT term, doc_id, list(pos ORDER BY pos) AS ps FROM rows GROUP BY 1, 2)",
        "gap_decode": rows + "SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM rows WHERE term = 'licens' GROUP BY 1",
        "append_positions": rows + f"SELECT doc_id, 1 + count(pos) AS tf, 1 + max(len) AS last FROM (SELECT doc_id, len({sql.terms('text')}) AS len FROM documents) LEFT JOIN (SELECT doc_id, pos FROM rows WHERE term = 'the') USING (doc_id) GROUP BY 1",
        "append_anchors": f"WITH {sql.field_tf()} SELECT term, doc_id, sum(tf)::BIGINT AS tf FROM (SELECT term, doc_id, tf FROM ftf WHERE field = 'anchor' AND term IN ('licens', 'inbound') UNION ALL SELECT unnest(['inbound', 'licens']), doc_id, 1 FROM documents) GROUP BY 1, 2",
        "analyze_stems": f"WITH {sql.voc()} SELECT term, tf FROM voc",
        "stop_words": f"WITH stopped AS ({sql.stop_terms()}), {sql.stems('stopped')} SELECT DISTINCT term FROM stems",
        "search_term": rows + _hit(_has("licens")), "bool_and": rows + _hit(f"{_has('the')} AND {_has('tion')}"), "bool_or": rows + _hit(f"{_has('licens')} OR {_has('reserv')}"),
        "bool_and_not": rows + _hit(f"{_has('the')} AND NOT {_has('tion')}"),
        "bool_pure_not": rows + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM rows WHERE term = 'the')",
        "bool_query_nested": rows + _hit(f"({_has('licens')} OR {_has('reserv')}) AND NOT {_has('tion')}"),
        "prefix_search": rows + _hit(f"bool_or(term LIKE '{PREFIX}%')"),
        "phrase_search": rows + "SELECT DISTINCT a.doc_id FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'",
        "bool_phrase_prefix": rows + f"{_hit(f'''bool_or(term LIKE 'licens%' OR term LIKE '{PREFIX}%') AND NOT {_has('reserv')}''')} INTERSECT SELECT a.doc_id FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'",
        "postings_intersect": f"WITH {sql.tf()} SELECT doc_id, tf FROM tf WHERE term = 'the' AND doc_id IN (SELECT doc_id FROM tf WHERE term = 'tion')",
        "postings_union": f"WITH {sql.tf()} SELECT term, doc_id, tf FROM tf WHERE term = 'licens' OR (term = 'reserv' AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'licens'))",
        "postings_difference": f"WITH {sql.tf()} SELECT doc_id, tf FROM tf WHERE term = 'the' AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'tion')",
        "bm25_topk": f"WITH {sql.bm25(sql.listed(WORDS))} {sql.top(10)}",
        "bm25_weighted": f"WITH {sql.voc()}, wanted AS (SELECT 1 AS query_id, 'licens' AS term, 2.0 AS w UNION ALL SELECT 1, 'right', 0.5), {sql.score()} {sql.top(10)}",
        "bm25_batch": f"WITH {sql.bm25('SELECT DISTINCT item_id AS query_id, unnest(' + sql.terms('text') + ') AS t, 1.0 AS w FROM benchmark')} {sql.top(3, 7, 3)}",
        "bm25_pagerank": f"WITH {sql.bm25(sql.listed(WORDS))}, {_mixed()} {sql.top(10, src='mixed')}",
        "bm25f_topk": f"WITH {sql.bm25f(sql.listed(WORDS))} {sql.top(10)}",
        "bm25f_no_title": f"WITH {sql.bm25f(sql.listed(WORDS)).replace('THEN 4.0', 'THEN 0.0').replace('JOIN fdf USING (term) GROUP', 'JOIN fdf USING (term) WHERE x > 0 GROUP')} {sql.top(10)}",
        "bm25f_pagerank": f"WITH {sql.bm25f(sql.listed(WORDS))}, {_mixed()} {sql.top(10, src='mixed')}",
        "prf_expansion_terms": f"WITH {_prf_bm25()} SELECT term, round(w, 6) AS w FROM x",
        "prf_query_string": f"WITH {_prf_bm25()} SELECT 1 AS query_id, '{' '.join(FEEDBACK)} ' || string_agg(term, ' ' ORDER BY round(w, 9) DESC, term) AS text FROM x WHERE isnew",
        "bm25_prf": f"WITH {_prf_bm25()}, w2 AS (SELECT 1 AS query_id, term, w FROM x), {sql.score('w2', 'sc2')} {sql.top(10, 7, 5, 'sc2')}",
        "bm25f_prf_terms": f"WITH {_prf_bm25f()} SELECT term, round(w, 6) AS w FROM x",
        "bm25f_prf": f"WITH {_prf_bm25f()}, w2 AS (SELECT 1 AS query_id, term, w FROM x), sc2 AS (SELECT w2.query_id, soft.doc_id, sum(w2.w * {sql.idf('fdf.df')} * x * 2.2 / (1.2 + x)) AS score FROM soft JOIN w2 USING (term) JOIN fdf USING (term) GROUP BY 1, 2) {sql.top(10, 7, 5, 'sc2')}",
        "graph_degrees": f"WITH {edges}, a AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), b AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1) SELECT {both.format('node')} AS node, coalesce(a.n, 0) AS out_degree, coalesce(b.n, 0) AS in_degree FROM a FULL JOIN b ON a.node = b.node",
        "graph_neighbors": f"WITH {edges}, a AS (SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS n FROM e GROUP BY 1), b AS (SELECT dst AS node, string_agg(src::VARCHAR, ',' ORDER BY src) AS n FROM e GROUP BY 1) SELECT {both.format('node')} AS node, coalesce(a.n, '') AS out, coalesce(b.n, '') AS in_ FROM a FULL JOIN b ON a.node = b.node",
        "graph_stats": f"WITH {edges} SELECT count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM e",
        "pagerank_k_iter": f"WITH {nodes} SELECT node, round(pr, 9) AS pagerank FROM r3",
        "pagerank_converged": f"WITH {nodes} SELECT node, round(pr, 6) AS pagerank FROM r30",
        "vec_norm": f"SELECT vec_id AS doc_id, round(sqrt({sql.dot('embedding', 'embedding')}), 6) AS norm FROM embeddings",
        "vec_normalize": f"SELECT vec_id AS doc_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt({sql.dot('embedding', 'embedding')}), 6) AS total FROM embeddings",
        "vec_upsert": "SELECT vec_id AS doc_id, 16::BIGINT AS dimension FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id - 100, 16 FROM embeddings WHERE vec_id < 5",
        "knn_single": f"WITH {sql.neighbours('q.vec_id = 7')} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM kt WHERE rank <= 10",
        "knn_batch": f"WITH {sql.neighbours('q.vec_id % 100 = 0')} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM kt WHERE rank <= 5",
        "hybrid_rrf": _fused(_RRF), "hybrid_rrf_pagerank": _fused(_RRF + " * (1 + ln(1 + 15.0 * (CASE WHEN coalesce(lex.doc_id, sem.doc_id) IN (SELECT doc_id FROM documents) THEN 1.0 / (1 + coalesce(lex.doc_id, sem.doc_id)) ELSE 0 END)))"),
        "hybrid_linear": _fused("0.5 * (coalesce(lex.score, 0) - (SELECT min(score) FROM lex)) / ((SELECT max(score) FROM lex) - (SELECT min(score) FROM lex)) + 0.5 * greatest(0.0, least(1.0, (coalesce(sem.score, 0) + 1) / 2))"),
        "hybrid_lexical_mode": _fused("lex.score", "LEFT JOIN"), "hybrid_semantic_mode": _fused("sem.score", "RIGHT JOIN"),
        "ngram_counts": f"SELECT * FROM {sql.grams('text', 'documents', 3, 1)}",
        "ngram_title_weighted": f"WITH halves AS (SELECT split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents) SELECT term, sum(tf)::BIGINT AS tf, sum(df)::BIGINT AS df FROM (SELECT * FROM {sql.grams('title', 'halves', 4, 3, False)} UNION ALL SELECT * FROM {sql.grams('body', 'halves', 3, 1)}) GROUP BY 1",
        "suggest_topk": f"WITH {sql.voc()} SELECT term, tf, df FROM voc WHERE term LIKE 'th%' ORDER BY tf DESC, df DESC, term LIMIT 8",
        "suggest_with_query_log": f"WITH {sql.voc()}, q AS (SELECT lower(trim(text)) AS term FROM conversations WHERE role = 'user'), al AS (SELECT term, tf, df FROM voc UNION ALL SELECT term, 5, 1 FROM q WHERE strlen(term) >= 2 AND NOT starts_with(term, ':')) "
                                  "SELECT term, sum(tf)::BIGINT AS tf, sum(df)::BIGINT AS df FROM al WHERE term LIKE 'wh%' GROUP BY 1 ORDER BY tf DESC, df DESC, term LIMIT 8",
        "prefix_terms": f"WITH {sql.voc()} SELECT term FROM voc WHERE term LIKE '{PREFIX}%'",
        "term_frequency": f"WITH {sql.voc()} SELECT term, tf, df FROM voc WHERE term = 'licens'",
        "spell_vocab": f"SELECT term, tf FROM {sql.grams('text', 'documents', 1, 1)}",
        "spell_suggest": f"WITH {spell} SELECT word, term AS suggestion, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, left(word, 1) = left(term, 1) DESC, tf DESC, term) AS rn FROM near WHERE distance <= 2) WHERE rn = 1",
        "snippet_fallback": "SELECT doc_id, CASE WHEN length(text) <= 160 THEN text WHEN regexp_matches(left(text, 160), '(?s)^.*\\s') THEN regexp_extract(left(text, 160), '(?s)^(.*)\\s', 1) || ' ...' ELSE left(text, 160) || ' ...' END AS opening FROM documents",
        "percent_decode": "SELECT page_id, 'a b c/' || page_id AS decoded FROM pages",
        "host_counts": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1",
        "page_titles": f"SELECT page_id, trim(regexp_replace({_ENT.format('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '\\s+', ' ', 'g')) AS title FROM pages",
        "page_text_len": f"SELECT page_id, length(trim(regexp_replace({_ENT.format(_TEXT)}, '\\s+', ' ', 'g')))::INT AS n FROM pages",
        "robots_allowed": f"SELECT page_id, path, coalesce(list_max(list_filter([CASE WHEN starts_with(path, '/a') THEN {{'n': 2, 'ok': false}} END, CASE WHEN regexp_matches(path, '^/a.*e') THEN {{'n': 4, 'ok': true}} END, CASE WHEN regexp_matches(path, '^/.*\\.html$') THEN {{'n': 8, 'ok': false}} END, "
                          f"CASE WHEN starts_with(path, '/t') THEN {{'n': 2, 'ok': false}} END], lambda x: x IS NOT NULL)).ok, true) AS allowed FROM (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM pages)",
        "robots_agents": f"SELECT page_id, NOT starts_with({_PATH}, '/a') AS allowed FROM pages",
        "frontier_schedule": f"SELECT row_number() OVER (PARTITION BY host ORDER BY seq)::INT AS wave, host, seq FROM (SELECT {_HOST} AS host, page_id AS seq FROM pages)",
        "incremental_ingest_stats": f"WITH {meta} SELECT 'new' AS title, CASE WHEN m.url IS NULL THEN '' ELSE 'text' END AS body, CASE WHEN m.url IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS pagerank, count(*) AS n FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN meta m USING (url) GROUP BY ALL",
        "update_pageranks": f"WITH {meta} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS pagerank FROM meta",
        "eval_metrics": f"WITH {ranked} SELECT 1 AS query_id, round(p, 6) AS p, round(r, 6) AS r, round(rr, 6) AS rr, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg FROM {_eval_sql('rk')}",
        "eval_suite": f"WITH {ranked}, a AS MATERIALIZED (SELECT * FROM {_eval_sql('rk')}), b AS MATERIALIZED (SELECT * FROM {_eval_sql('rk', 5)}) SELECT metric, round(value, 6) AS value FROM (SELECT 'map' AS metric, ap AS value FROM a UNION ALL SELECT 'mrr', rr FROM a UNION ALL SELECT 'p10', p FROM a "
                      "UNION ALL SELECT 'r10', r FROM a UNION ALL SELECT 'ndcg10', ndcg FROM a UNION ALL SELECT 'p5', p FROM b UNION ALL SELECT 'ndcg5', ndcg FROM b)",
    }
