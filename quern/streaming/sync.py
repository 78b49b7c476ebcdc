"""Incremental sync of notes: change detection as a join in batches and as keyed state in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quern.session import table

#: Seconds by which times of change may differ.
TOLERANCE = 2.0
#: Seconds between scans, and the least that is allowed.
INTERVAL, LEAST_INTERVAL = 15, 3


def decide_column():  # noqa: ANN201
    """Why a file is read again, from base (``b_``) and current columns ``mtime, size, prefix``."""
    step = F.col("mtime") - F.col("b_mtime")
    near = F.abs(step) <= TOLERANCE
    return (
        F.when(F.col("b_path").isNull(), "new")
        .when(step > TOLERANCE, "mtime-advanced")
        .when(near & (F.col("size") != F.col("b_size")), "size-changed")
        .when(near & (F.coalesce("b_prefix", F.lit("")) == ""), "baseline-missing")
        .when(near & (F.col("prefix") != F.col("b_prefix")), "same-length-edit")
        .when(near, "unchanged")
        .otherwise("mtime-rewound")
    )


def decide(base: DataFrame, current: DataFrame) -> DataFrame:
    """``rel_path, decision`` of every current file against the last state; both have ``rel_path, mtime, size, prefix``."""
    b = base.select(F.col("rel_path").alias("b_path"), F.col("mtime").alias("b_mtime"), F.col("size").alias("b_size"), F.col("prefix").alias("b_prefix"))
    return current.join(b, F.col("rel_path") == F.col("b_path"), "left").select("rel_path", decide_column().alias("decision"))


def plan_sync(base: DataFrame, current: DataFrame) -> DataFrame:
    """What a scan does: ``rel_path, action`` (upsert or delete) and its reason."""
    up = decide(base, current).where(~F.col("decision").isin("unchanged", "mtime-rewound")).select("rel_path", F.lit("upsert").alias("action"), F.col("decision").alias("reason"))
    gone = base.join(current.select("rel_path"), "rel_path", "left_anti").select("rel_path", F.lit("delete").alias("action"), F.lit("vanished").alias("reason"))
    return up.unionByName(gone)


class ChangeDetector(StatefulProcessor):
    """The same decision with one state per path: time, size and prefix of the last version read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mtime double, size long, prefix string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        seen = pd.concat(list(rows)).sort_values("mtime")
        out = []
        for r in seen.itertuples(index=False):
            old = self.last.get() if self.last.exists() else None
            reason = self._reason(old, r)
            if reason not in ("unchanged", "mtime-rewound"):
                self.last.update((float(r.mtime), int(r.size), r.prefix))
            out.append((key[0], reason))
        yield pd.DataFrame(out, columns=["rel_path", "decision"])

    @staticmethod
    def _reason(old, r) -> str:  # noqa: ANN001
        if old is None:
            return "new"
        mtime, size, prefix = old
        if r.mtime - mtime > TOLERANCE:
            return "mtime-advanced"
        if r.mtime - mtime < -TOLERANCE:
            return "mtime-rewound"
        if r.size != size:
            return "size-changed"
        if not prefix:
            return "baseline-missing"
        return "same-length-edit" if r.prefix != prefix else "unchanged"

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        r = initialState.iloc[0]
        self.last.update((float(r["mtime"]), int(r["size"]), r["prefix"]))

    def close(self) -> None:
        pass


def detect_changes(stream: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Decisions of a stream of file states (``rel_path, mtime, size, prefix``); needs the RocksDB state store."""
    grouped = stream.groupBy("rel_path")
    return grouped.transformWithStateInPandas(ChangeDetector(), "rel_path string, decision string", "Append", "None", initial.groupBy("rel_path") if initial is not None else None)


def follow(spark: SparkSession, folder: str, state_path: str, apply: Callable[[DataFrame, int], None], interval: int = INTERVAL, once: bool = False) -> StreamingQuery:
    """Scan a folder of note states on a clock and hand each plan to ``apply``.

    A file source tells neither deletions nor files written anew under one name, so
    each tick lists the folder and compares it with the state written last. The state
    of a tick is written under its number before the next begins; a tick that is run
    again writes the same, and a failed one leaves the state as it was.
    """
    from quern.sources.scan import scan_notes

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    empty = "rel_path string, mtime double, size long, prefix string"

    def tick(_: DataFrame, batch: int) -> None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(state_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        last = max((b for b in range(batch) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{b}/_SUCCESS"))), default=None)
        base = spark.read.schema(empty).parquet(f"{state_path}/{last}") if last is not None else spark.createDataFrame([], empty)
        now = scan_notes(spark, folder).select("rel_path", (F.unix_micros("mtime") / 1e6).alias("mtime"), F.col("file_size").alias("size"), F.sha1(F.substring(F.col("text").cast("binary"), 1, 4096)).alias("prefix"))
        now.write.mode("overwrite").parquet(f"{state_path}/{batch}")
        apply(plan_sync(base, spark.read.schema(empty).parquet(f"{state_path}/{batch}")), batch)

    w = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{state_path}/checkpoint")
    return w.trigger(once=True).start() if once else w.trigger(processingTime=f"{max(LEAST_INTERVAL, interval)} seconds").start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; works on streams, where rows later than ``late`` are dropped, and on tables."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, parted by a gap."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the library: the second drops, touches, grows and edits some notes by their ids."""
    n = table(s, d, "documents").where("rel_path is not null")
    prefix = F.coalesce(F.sha1(F.substring(F.col("text").cast("binary"), 1, 4096)), F.lit(""))
    k = F.col("doc_id") % 10
    base = n.where(k != 0).select("rel_path", "mtime", F.col("file_size").alias("size"), F.when(k == 5, "").otherwise(prefix).alias("prefix"))
    now = n.where(k != 9).select(
        "rel_path",
        (F.col("mtime") + F.when(k == 1, 60.0).when(k == 2, -60.0).otherwise(0.0)).alias("mtime"),
        (F.col("file_size") + F.when(k == 3, 7).otherwise(0)).alias("size"),
        F.when(k == 4, F.concat(prefix, F.lit("x"))).otherwise(prefix).alias("prefix"),
    )
    return base, now


def r2_decisions(s: SparkSession, d: str) -> DataFrame:
    return decide(*_snapshots(s, d)).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def r4_sync_plan(s: SparkSession, d: str) -> DataFrame:
    return plan_sync(*_snapshots(s, d))


def r9_tumbling(s: SparkSession, d: str) -> DataFrame:
    return tumbling(table(s, d, "events")).select(F.unix_seconds("start").alias("start"), "event_type", "n", "total")


def r9_sessions(s: SparkSession, d: str) -> DataFrame:
    return sessions(table(s, d, "events")).select(F.unix_micros("start").alias("start"), "user_id", "n")


QUERIES = {f.__name__: f for f in [r2_decisions, r4_sync_plan, r9_tumbling, r9_sessions]}
_SNAP = """with b as (select doc_id, rel_path, mtime, file_size size, case when doc_id % 10 = 5 then '' else coalesce(md5(text), '') end p from documents where rel_path is not null and doc_id % 10 <> 0),
 c as (select rel_path, mtime + case doc_id % 10 when 1 then 60 when 2 then -60 else 0 end mtime, file_size + case when doc_id % 10 = 3 then 7 else 0 end size, case when doc_id % 10 = 4 then coalesce(md5(text), '') || 'x' else coalesce(md5(text), '') end p from documents where rel_path is not null and doc_id % 10 <> 9),
 j as (select c.rel_path, case when b.rel_path is null then 'new' when c.mtime - b.mtime > 2 then 'mtime-advanced' when abs(c.mtime - b.mtime) <= 2 and c.size <> b.size then 'size-changed' when abs(c.mtime - b.mtime) <= 2 and b.p = '' then 'baseline-missing' when abs(c.mtime - b.mtime) <= 2 and c.p <> b.p then 'same-length-edit' when abs(c.mtime - b.mtime) <= 2 then 'unchanged' else 'mtime-rewound' end decision from c left join b using (rel_path))"""
SQL = {
    "r2_decisions": _SNAP + " select decision, count(*) as n from j group by 1",
    "r4_sync_plan": _SNAP + " select rel_path, 'upsert' as action, decision as reason from j where decision not in ('unchanged', 'mtime-rewound') union all select rel_path, 'delete', 'vanished' from b where rel_path not in (select rel_path from c)",
    "r9_tumbling": "select (epoch_us(ts) // 3600000000) * 3600 as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "r9_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 30 minutes or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from g)
 select epoch_us(min(ts)) as start, user_id, count(*) as n from s group by user_id, k""",
}
