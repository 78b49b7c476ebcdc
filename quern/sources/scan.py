"""Scans of folders and sinks of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import display_source, doc_id_of, frontmatter, markdown_title


def scan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown notes below a folder: ``rel_path, text, file_size, mtime``; bytes that are no UTF-8 are replaced."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(root) + "/*", "")
    return f.select(rel.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder for ``convert_files``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def documents_of(notes: DataFrame) -> DataFrame:
    """The index row of each note."""
    meta = frontmatter(F.col("text"))
    title = markdown_title(F.col("text"), F.col("rel_path"))
    return notes.select(
        doc_id_of(F.col("rel_path")).alias("doc_id"),
        "rel_path",
        "file_size",
        (F.unix_micros("mtime") / 1e6).alias("mtime"),
        title.alias("title"),
        F.coalesce(meta["status"], F.lit("success")).alias("status"),
        F.sha1(F.substring(F.col("text").cast("binary"), 1, 4096)).alias("prefix_hash"),
        display_source(meta["source_file"], title, F.col("rel_path")).alias("display_source"),
    )


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of JSON rows; a row that can't be read is an error, never an empty store."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_index(rows: DataFrame, path: str, buckets: int = 64, key: str = "doc_id") -> None:
    """Write a table of the index, partitioned by a hash of its note, so that a note's rows are replaced together."""
    rows.withColumn("doc_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("doc_bucket").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_notes(index: DataFrame, fresh: DataFrame, gone: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The index with the rows of ``fresh`` in place of those of the same notes, and without notes of ``gone``."""
    out = index.join(fresh.select(key).distinct(), key, "left_anti")
    if gone is not None:
        out = out.join(gone.select(key).distinct(), key, "left_anti")
    return out.unionByName(fresh)
