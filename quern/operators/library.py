"""The user's organisation of notes: collections, titles, trash and what is purged with a note."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.keywords import keywords
from quern.functions.paths import safe_filename
from quern.session import table
from quern.sources.convert import capabilities


def assign(membership: DataFrame, changes: DataFrame, collections: DataFrame) -> DataFrame:
    """New memberships (``doc_id, collections``): wanted ids each once and in order, unknown ids dropped, unchanged notes kept.

    The list of collections is the user's and small, but it is joined, not collected.
    """
    wanted = changes.select("doc_id", F.posexplode(F.array_distinct("collections")).alias("pos", "id")).join(collections.select("id"), "id", "left_semi")
    fresh = wanted.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias("collections"))
    emptied = changes.select("doc_id").join(fresh, "doc_id", "left").select("doc_id", F.coalesce("collections", F.array().cast("array<string>")).alias("collections"))
    return membership.join(changes.select("doc_id"), "doc_id", "left_anti").select("doc_id", "collections").unionByName(emptied)


def create_collection(collections: DataFrame, id_: str, name: str, created_at: str) -> DataFrame:
    """Collections (``id, name, created_at``) with one more; an id that is there already is kept as it is."""
    spark = collections.sparkSession
    new = spark.createDataFrame([(id_, name, created_at)], "id string, name string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return collections.unionByName(new.join(collections.select("id"), "id", "left_anti"))


def rename_collections(collections: DataFrame, names: DataFrame) -> DataFrame:
    """Collections with new names (``id, name``); blank names change nothing."""
    fresh = names.where(F.trim("name") != "").select("id", F.trim("name").alias("_name"))
    return collections.join(fresh, "id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def drop_collections(collections: DataFrame, gone: DataFrame) -> DataFrame:
    """Collections without some; their notes stay."""
    return collections.join(gone.select("id"), "id", "left_anti")


def in_trash(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """Notes that are in the trash by its log (``trashed_at, restored_at``): the last entry of each counts."""
    order = F.struct(F.coalesce("trashed_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("restored_at", F.lit("9999-01-01").cast("timestamp")))
    last = log.groupBy(key).agg(F.max_by(F.struct("restored_at", "trashed_at"), order).alias("e"))
    return last.where("e.restored_at is null").select(key, F.col("e.trashed_at").alias("trashed_at"))


def delete_collection(membership: DataFrame, collection: str) -> DataFrame:
    """Memberships without a collection; its notes stay."""
    return membership.withColumn("collections", F.array_remove("collections", collection))


def members_of(membership: DataFrame, collection: str) -> DataFrame:
    return membership.where(F.array_contains("collections", collection)).select("doc_id")


def purge(index: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table of an index without the rows of some notes."""
    k = gone.select(key).distinct()
    return {name: df.join(k, key, "left_anti") for name, df in index.items()}


def visible(notes: DataFrame, trash: DataFrame, key: str = "doc_id") -> DataFrame:
    """Notes that are not in the trash; restored ones are not."""
    return notes.join(trash.where("restored_at is null").select(key).distinct(), key, "left_anti")


def with_keywords(notes: DataFrame, limit: int = 12) -> DataFrame:
    """``doc_id, keywords`` of notes (``doc_id, title, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [[t for t, _ in keywords(x, t or "", limit)] for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k, pa.list_(pa.string()))], ["doc_id", "keywords"])

    t = notes.schema["doc_id"].dataType.simpleString()
    return notes.select("doc_id", "title", "text").mapInArrow(run, f"doc_id {t}, keywords array<string>")


def _k(c: str):  # noqa: ANN202
    return F.lower(F.trim(F.col(c)))


def l2_members(s: SparkSession, d: str) -> DataFrame:
    """Folders as collections: notes are assigned to two of them, one of which is unknown."""
    docs = table(s, d, "documents")
    folder = F.substring_index("rel_path", "/", 1)
    known = docs.select(folder.alias("id")).distinct().where("id <> 'clips'")
    base = docs.select("doc_id", F.array(F.lit("inbox")).alias("collections"))
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.array(folder, F.lit("clips"), folder).alias("collections"))
    return assign(base, changes, known).select("doc_id", F.array_join("collections", ",").alias("collections"))


def l4_purged(s: SparkSession, d: str) -> DataFrame:
    """Rows left per table after the notes in the trash are purged."""
    gone = table(s, d, "trash").where("restored_at is null").select(_k("doc_id").alias("doc"))
    index = {n: table(s, d, n).withColumn("doc", _k(c)) for n, c in (("documents", "doc_key"), ("parent_blocks", "doc_id"), ("chunk_metadata", "doc_id"), ("chunks", "doc_id"))}
    out = None
    for n, df in purge(index, gone, "doc").items():
        c = df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(n).alias("name"), "rows_left")
        out = c if out is None else out.unionByName(c)
    return out


def l5_visible(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "documents").select("doc_id", _k("doc_key").alias("doc"))
    trash = table(s, d, "trash").select(_k("doc_id").alias("doc"), "restored_at")
    return visible(notes, trash, "doc").select("doc_id")


def x10_keywords(s: SparkSession, d: str) -> DataFrame:
    return with_keywords(table(s, d, "documents")).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def x17_safe_names(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def clean(c):  # noqa: ANN001, ANN202
        return c.map(safe_filename)

    return table(s, d, "documents").where("title is not null").select("doc_id", clean(F.concat("title", F.lit(".md"))).alias("file_name"))


def s21_capabilities(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(capabilities(), "extension string, kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("extensions"))


def a6_hits_by_note(s: SparkSession, d: str) -> DataFrame:
    """Notes among the chunks that hold a word, with their number and first chunk."""
    c = table(s, d, "chunks").where(F.lower("content").contains("valve") | F.col("content").contains("阀"))
    return c.where("doc_id is not null").groupBy(_k("doc_id").alias("doc")).agg(F.count_distinct("chunk_id").alias("n"), F.min("chunk_id").alias("first_chunk"))


QUERIES = {f.__name__: f for f in [l2_members, l4_purged, l5_visible, x10_keywords, x17_safe_names, s21_capabilities, a6_hits_by_note]}
_GONE = "select lower(trim(doc_id)) from trash where restored_at is null and doc_id is not null"
SQL = {
    "l2_members": "select doc_id, case when doc_id % 3 = 0 then case when split_part(rel_path, '/', 1) = 'clips' then '' else split_part(rel_path, '/', 1) end else 'inbox' end as collections from documents",
    "l4_purged": " union all ".join(f"select '{n}' as name, count(*) as rows_left from {n} where coalesce(lower(trim({c})), '') not in ({_GONE})" for n, c in (("documents", "doc_key"), ("parent_blocks", "doc_id"), ("chunk_metadata", "doc_id"), ("chunks", "doc_id"))),
    "l5_visible": f"select doc_id from documents where lower(trim(doc_key)) not in ({_GONE})",
    "a6_hits_by_note": "select lower(trim(doc_id)) as doc, count(distinct chunk_id) as n, min(chunk_id) as first_chunk from chunks where doc_id is not null and (contains(lower(content), 'valve') or contains(content, '阀')) group by 1",
}
