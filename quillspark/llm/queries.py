"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, chunk_codec, line_dedup, packing, quality, secrets, simhash, spotsigs, token_store, toxicity
from .common import shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, _crc_mod(4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_crc_mod(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_sentences", F.size("offending").cast("long").alias("n_offending"), F.get(F.col("offending.start"), F.lit(0)).alias("first_offence"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(_documents(spark, sf_dir), trees).select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"),
        F.transform("secrets", lambda s: F.sha2(s["value"], 256)).alias("secret_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.store_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), shared_dir(spark), end_id=2)
    return token_store.digest_documents(spark, files)


def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.digests(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(_documents(spark, sf_dir), removed_col="n_removed").select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), tau=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), capacity=2048)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(_documents(spark, sf_dir))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_crc_mod(10) == 0, F.lit(False))
    return bloom_lm.score(_documents(spark, sf_dir), train=~held, held_out=held)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_toxicity, op2_secrets, op3_token_files, op4_chunk_bpe, op5_line_spread, op6_simhash, op7_best_fit, op8_spotsigs, op9_bloom_lm, op10_quality, pipeline)
    return {f.__name__: f for f in own}


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    blank = "[^\\x20\\x09-\\x0D]"
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END"
    verdict = " AND ".join(f"{r.metric} >= {r.least}" for r in quality.RULES if r.least is not None) + " AND " + " AND ".join(f"{r.metric} <= {r.most}" for r in quality.RULES if r.most is not None)
    return (f"WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{blank}+') AS ws FROM documents), "
            "w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d), "
            "t AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
            "r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM t WHERE w3 IS NOT NULL) WHERE c > 1), "
            "rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1), "
            f"l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{blank}') GROUP BY 1), "
            f"s AS (SELECT doc_id, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (lower(w) IN ({stop})) AS n_stop FROM w GROUP BY 1), "
            "m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, "
            "coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(l.n, 0) AS lines FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)), "
            f"q AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'n_words')} AS symbol_ratio, "
            f"{ratio('n_stop', 'n_words')} AS stop_ratio, {ratio('n_dup_lines', 'lines')} AS dup_line_ratio, {ratio('n_repeat_words', 'n_words')} AS repeat_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m) "
            f"SELECT *, NOT base_failed AND {verdict} AS kept FROM q")


def oracle_sql():
    return {"op10_quality": _quality_sql()}
