"""Session set-up, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}


def build_session(app: str = "quern", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects; clusters bring their own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("quern") / p.relative_to(root)))
    target.write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory; Catalyst prunes what the query does not use."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    It is the folder named by ``spark.checkpoint.dir``. Only where that is
    unset, as in tests on one machine, a temporary folder is made.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="quern-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        _SCRATCH[app] = f"{base.rstrip('/')}/quern-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def cpu_tasks(spark: SparkSession) -> int:
    """Tasks for a stage bound by computing: an explicit number isn't merged by size, as adaptive plans do with small partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    The result has no lineage into ``df``: a lost executor costs a re-read of
    the files, not a second run of what made them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
