"""References to records that do not exist, were deleted or arrived later.

Keys are text, so each key is split into a stem and its trailing integer
(``6d..:p12`` becomes ``6d..:p`` and 12). The integers of one stem are sorted
and compressed into contiguous runs. A reference is matched as-of to the run
with the greatest start not above it: it exists if it is not beyond the run's
end. A section's blocks ``p0 .. pN`` thus cost one run, not N keys.

All stages are built-in expressions. Sorting is bounded: a run never crosses a
multiple of ``BUCKET``, so a window holds at most ``BUCKET`` keys however many
integers share a stem, and references enter it once per distinct key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.skew import lookup, merged
from quern.session import table

#: Integers are sorted and matched within blocks of this many; runs end at block borders.
BUCKET = 1 << 16

_SPLIT = r"^(.*?)([1-9][0-9]{0,17}|0)?$"


def norm_key(c: Column) -> Column:
    """Keys agree after removing outer spaces and lower-casing; blank is null."""
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def split_key(df: DataFrame, key: str) -> DataFrame:
    """Add ``stem``, ``num`` (-1 without trailing digits) and ``block``; concatenating stem and num gives the key again."""
    digits = F.regexp_extract(F.col(key), r"(?s)" + _SPLIT, 2)
    num = F.when(digits != "", digits.cast("long")).otherwise(F.lit(-1))
    return df.withColumn("num", num).withColumn("stem", F.expr(f"substring({key}, 1, length({key}) - if(num < 0, 0, length(string(num))))")).withColumn("block", F.expr(f"num div {BUCKET}"))


def runs_of(keys: DataFrame, key: str = "key") -> DataFrame:
    """Compress distinct keys into runs: ``stem, block, run_start, run_end``."""
    k = split_key(keys.select(key).where(F.col(key).isNotNull()).distinct(), key)
    w = W.partitionBy("stem", "block").orderBy("num")
    islands = k.withColumn("island", F.col("num") - F.row_number().over(w))
    return islands.groupBy("stem", "block", "island").agg(F.min("num").alias("run_start"), F.max("num").alias("run_end")).drop("island")


def beyond_runs(refs: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """As-of match distinct reference keys to runs; adds ``present``.

    A reference before every run of its stem, or beyond the end of the run it
    is matched to, is not present.
    """
    carried = [c for c in refs.columns if c != key]
    r = split_key(refs, key).select("stem", "block", F.col("num").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("run_end"), key, F.struct(*carried, F.lit(0).alias("_")).alias("carried"))
    s = runs.select("stem", "block", F.col("run_start").alias("at"), F.lit(0).alias("kind"), "run_end")
    w = W.partitionBy("stem", "block").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    m = r.unionByName(s, allowMissingColumns=True).withColumn("end", F.last("run_end", ignorenulls=True).over(w))
    return m.where("kind = 1").select(key, *[F.col(f"carried.{c}").alias(c) for c in carried], F.coalesce(F.col("at") <= F.col("end"), F.lit(False)).alias("present"))


def find_orphans(refs: DataFrame, parents: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Judge every reference.

    ``refs`` has ``ref`` (raw key), ``at`` (timestamp) and any other columns;
    ``parents`` has ``key`` and ``at``; ``deleted`` has ``key``. Adds ``orphan``:
    ``missing`` (no such parent), ``deleted``, ``later`` (``at`` is before the
    parent's earliest ``at``) or null. The first that holds counts. Null and
    blank references are no references and get null. Null times are never
    earlier or later. Empty tables give only ``missing`` or nothing at all.
    """
    rows = refs.withColumn("_key", norm_key(F.col("ref")))
    known = parents.select(norm_key(F.col("key")).alias("_key"), "at").where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("at").alias("_first"))
    used = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("_refs"))
    matched = beyond_runs(used, runs_of(known, "_key"), "_key")
    facts = merged(matched, known, "_key", "left")
    if deleted is not None:
        gone = deleted.select(norm_key(F.col("key")).alias("_key")).where(F.col("_key").isNotNull()).distinct().withColumn("_gone", F.lit(True))
        facts = merged(facts, gone, "_key", "left")
    else:
        facts = facts.withColumn("_gone", F.lit(None).cast("boolean"))
    facts = facts.where(~F.col("present") | F.col("_gone") | F.col("_first").isNotNull())
    judged = lookup(rows, facts, "_key", "_refs")
    orphan = F.when(~F.col("present"), "missing").when(F.col("_gone"), "deleted").when(F.col("at") < F.col("_first"), "later")
    return judged.withColumn("orphan", orphan).drop("_key", "present", "_gone", "_first")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_key").alias("key"), F.col("indexed_at").alias("at"))
    blocks, chunks = table(spark, d, "parent_blocks"), table(spark, d, "chunk_metadata")
    gone = table(spark, d, "trash").where("restored_at is null").select(F.col("doc_id").alias("key"))

    def side(df: DataFrame, name: str, key: str, field: str) -> DataFrame:
        return df.select(F.lit(name).alias("src_table"), F.col(key).alias("src_key"), F.lit(field).alias("src_field"), F.col(field).alias("ref"), F.col("indexed_at").alias("at"))

    to_docs = side(blocks, "parent_blocks", "parent_id", "doc_id").unionByName(side(chunks, "chunk_metadata", "chunk_id", "doc_id"))
    to_blocks = side(chunks, "chunk_metadata", "chunk_id", "parent_id")
    return find_orphans(to_docs, docs, gone).unionByName(find_orphans(to_blocks, blocks.select(F.col("parent_id").alias("key"), F.col("indexed_at").alias("at"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Source rows with a reference that is missing, deleted or later; distinct."""
    return _judged(spark, d).where("orphan is not null").select("src_table", "src_key", "src_field").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, kind and month of ``indexed_at`` (null month where that is null)."""
    return (
        _judged(spark, d)
        .where("orphan is not null")
        .groupBy("src_table", "src_field", "orphan", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )


_JUDGED_SQL = """
with docs as (select lower(trim(doc_key)) k, min(indexed_at) f from documents group by 1),
 blocks as (select lower(trim(parent_id)) k, min(indexed_at) f from parent_blocks group by 1),
 gone as (select distinct lower(trim(doc_id)) k from trash where restored_at is null),
 r as (select 'parent_blocks' src_table, parent_id src_key, 'doc_id' src_field, lower(trim(doc_id)) k, indexed_at t from parent_blocks
  union all select 'chunk_metadata', chunk_id, 'doc_id', lower(trim(doc_id)), indexed_at from chunk_metadata
  union all select 'chunk_metadata', chunk_id, 'parent_id', lower(trim(parent_id)), indexed_at from chunk_metadata),
 j as (select r.*, case when r.src_field = 'doc_id' and d.k is null or r.src_field = 'parent_id' and b.k is null then 'missing'
   when r.src_field = 'doc_id' and g.k is not null then 'deleted'
   when r.t < case when r.src_field = 'doc_id' then d.f else b.f end then 'later' end orphan
  from r left join docs d on r.k = d.k left join blocks b on r.k = b.k left join gone g on r.k = g.k where r.k <> '')
"""

SQL = {
    "p1_found": _JUDGED_SQL + "select distinct src_table, src_key, src_field from j where orphan is not null",
    "p1_report": _JUDGED_SQL + "select src_table, src_field, orphan, strftime(t, '%Y-%m') as month, count(*) as n_refs from j where orphan is not null group by all",
}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
