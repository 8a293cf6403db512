"""Stored indexes and page metadata: a folder of Parquet tables and a manifest that is written last.

Version 1 holds plain arrays. Version 2, the usual one, holds a term's documents in blocks: doc_ids and each posting's positions as gaps in
variable bytes. Postings are split by ranges of terms and sorted, so that a query's terms are found by the files' statistics. A term's
documents are cut into blocks of BLOCK documents, so no row grows with the corpus.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pack_udf, unpack_udf
from ..operators import index as ix

FORMAT, VERSIONS, BLOCK = "quillspark index", (1, 2), 4096
META = "doc_id long, url string, title string, body string, pagerank double"


class StorageError(Exception):
    """Reading or writing a store failed; ``kind`` is io, format, version, counts or compression."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_manifest(spark: SparkSession, path: str, note: dict) -> None:
    p, fs = _hadoop(spark, f"{path}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
    out.close()


def _manifest(spark: SparkSession, path: str, kind: str) -> dict:
    p, fs = _hadoop(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        raise StorageError("io", f"no manifest in {path}")
    stream = fs.open(p)
    raw = bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
    stream.close()
    try:
        note = json.loads(raw)
    except ValueError as e:
        raise StorageError("format", f"{path}: the manifest can't be read") from e
    if not isinstance(note, dict) or note.get("format") != kind:
        raise StorageError("format", f"{path} holds no {kind}")
    if note.get("version") not in VERSIONS:
        raise StorageError("version", f"{path}: version {note.get('version')} is unknown")
    return note


def _tables(index: ix.Index) -> dict[str, DataFrame]:
    named = {"postings": index.postings, "lengths": index.lengths, "field_postings": index.field_postings, "field_lengths": index.field_lengths}
    return {k: v for k, v in named.items() if v is not None}


def save_v1(index: ix.Index, path: str) -> None:
    _save(index, path, 1)


def save_v2(index: ix.Index, path: str) -> None:
    _save(index, path, 2)


save = save_v2


def _save(index: ix.Index, path: str, version: int) -> None:
    spark = index.postings.sparkSession
    rows = {}
    try:
        for name, table in _tables(index).items():
            if name == "postings" and version == 2:
                table = compressed(table)
            if "term" in table.columns:
                table = table.repartitionByRange("term").sortWithinPartitions("term")
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            rows[name] = spark.read.parquet(f"{path}/{name}").count()
        _write_manifest(spark, path, {"format": FORMAT, "version": version, "stemmed": index.stemmed, "rows": rows})
    except StorageError:
        raise
    except Exception as e:
        raise StorageError("io", f"can't write {path}: {e}") from e


def compressed(postings: DataFrame) -> DataFrame:
    """(term, block, n, docs, tfs, positions): up to BLOCK documents of a term by ranges of their ids."""
    rows = postings.select("term", F.floor(F.col("doc_id") / BLOCK).alias("block"), F.struct((F.col("doc_id") % BLOCK).cast("int").alias("doc"), "tf", pack_udf("positions").alias("p")).alias("e"))
    one = rows.groupBy("term", "block").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return one.select("term", "block", F.size("es").alias("n"), pack_udf(F.col("es.doc")).alias("docs"), F.col("es.tf").alias("tfs"), F.col("es.p").alias("positions"))


def expanded(blocks: DataFrame) -> DataFrame:
    """The postings of ``compressed``; a block whose number of documents isn't n fails."""
    docs = unpack_udf("docs")
    one = blocks.select("term", "block", "n", docs.alias("ds"), "tfs", "positions")
    whole = F.when((F.size("ds") == F.col("n")) & (F.size("tfs") == F.col("n")), F.arrays_zip("ds", "tfs", "positions")).otherwise(F.raise_error(F.lit("postings count mismatch")))
    flat = one.select("term", "block", F.explode(whole).alias("e"))
    return flat.select("term", (F.col("block") * BLOCK + F.col("e.ds")).alias("doc_id"), F.col("e.tfs").alias("tf"), unpack_udf(F.col("e.positions")).alias("positions"))


def load(spark: SparkSession, path: str, check: bool = True) -> ix.Index:
    """The stored index of either version. ``check`` compares the tables' row counts with the manifest."""
    note = _manifest(spark, path, FORMAT)
    tables = {}
    for name, n in note["rows"].items():
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            raise StorageError("io", f"{path}/{name} can't be read") from e
        if check and tables[name].count() != n:
            raise StorageError("counts", f"{path}/{name} has not the {n} rows of the manifest")
    if note["version"] == 2:
        tables["postings"] = expanded(tables["postings"])
    return ix.Index(tables["postings"], tables["lengths"], tables.get("field_postings"), tables.get("field_lengths"), None, note["stemmed"])


def save_metadata(meta: DataFrame, path: str) -> None:
    """Writes (doc_id, url, title, body, pagerank)."""
    try:
        meta.select("doc_id", "url", "title", "body", "pagerank").write.mode("overwrite").parquet(f"{path}/pages")
        n = meta.sparkSession.read.parquet(f"{path}/pages").count()
        _write_manifest(meta.sparkSession, path, {"format": "quillspark pages", "version": 1, "rows": {"pages": n}})
    except Exception as e:
        raise StorageError("io", f"can't write {path}: {e}") from e


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    note = _manifest(spark, path, "quillspark pages")
    meta = spark.read.schema(META).parquet(f"{path}/pages")
    if meta.count() != note["rows"]["pages"]:
        raise StorageError("counts", f"{path}/pages has not the rows of the manifest")
    return meta
