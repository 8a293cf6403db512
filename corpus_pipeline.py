"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal and secret scans into packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import line_dedup, packing, quality, secrets, simhash
from quillspark.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share; n_chars follows the text."""
    return line_dedup.remove(docs, n_chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies: texts of a five-word Jaccard index of 0.8 or more, and what they link."""
    return simhash.keep_one(docs, tau=6, shingle=5, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    trees = secrets.train(secrets.labelled_findings(spark))
    from pyspark.sql import functions as F

    return secrets.redact(docs, trees).select([F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The near-duplicate and packing stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
