"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:  # noqa: ANN001
    """A join by shuffle and sort, never by broadcast.

    For sides that grow with the data: the planner sees the size of compressed
    files or shuffle blocks, so a table near its broadcast limit may be many times
    as large in the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


#: A key is hot from this share of the rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.002


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows with a key: at most ``1 / share`` rows.

    Counts are combined on the map side, so the shuffle carries one row per key
    and task. The bound on the result is arithmetic, which makes it safe to broadcast.
    Nulls are no keys; an empty input has no hot keys.
    """
    per_key = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = per_key.agg(F.sum("_n").alias("_total"))
    return per_key.join(F.broadcast(total), F.col("_n") >= F.col("_total") * F.lit(share)).select(key)


def lookup(rows: DataFrame, facts: DataFrame, key: str, weight: str = "_refs", share: float = HOT_SHARE) -> DataFrame:
    """Left-join ``facts`` (one row per key, with the number of ``rows`` of each key in ``weight``) to ``rows``.

    Facts of hot keys are broadcast (at most ``1 / share`` of them, whatever the
    data); the rows of all other keys are joined by a shuffle in which no key is
    heavy. Keys without facts get nulls. Null keys match nothing.
    """
    total = facts.agg(F.sum(weight).alias("_total"))
    marked = facts.join(F.broadcast(total)).withColumn("_hot", F.col(weight) >= F.col("_total") * F.lit(share)).drop("_total")
    keys = [c for c in marked.columns if c not in (key, weight, "_hot")]
    hot = marked.where("_hot").select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in keys])
    cold = marked.where(~F.col("_hot")).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in keys])
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    is_hot, known = F.col("_hk").isNotNull(), F.col(key).isNotNull()
    # Rows that are settled already, and those without a key, get a spread-out key, so they don't meet in one task.
    # What it may match by chance is not taken: facts have one row per key, and only rows with a cold key read them.
    spread = F.xxhash64(*[F.col(c) for c in rows.columns])
    if rows.schema[key].dataType.typeName() != "long":
        spread = F.concat(F.lit("\u0000"), spread.cast("string"))
    probe = F.when(known & ~is_hot, F.col(key)).otherwise(spread)
    both = merged(first.withColumn("_probe", probe), cold, F.col("_probe") == F.col("_ck"), "left")
    return both.select(*[F.col(c) for c in rows.columns], *[F.when(is_hot, F.col(f"_h_{c}")).when(known, F.col(f"_c_{c}")).alias(c) for c in keys])
