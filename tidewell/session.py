"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # hash instead of sort a shuffled join when every measured partition is this small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows vary in length: a batch of them in Python is bounded by its bytes too
    "spark.sql.execution.arrow.maxBytesPerBatch": "8MB",
    # keyed state of the streams outgrows executor memory: keep it on disk
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_local_scratch: dict[str, str] = {}
_staged: list[str] = []


def local_session(cpus: int = 8, app: str = "tidewell", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWELL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidewell-warehouse-"))
    )
    for key, value in {**RUNTIME_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a given session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold within, and what was set before holds again after."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tidewell-scratch-")
        context.setCheckpointDir(_local_scratch[app])
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared scratch folder."""
    return f"{scratch_root(spark)}/tidewell/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing)
    and lets later passes prune columns.
    """
    path = staged_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table with so many rows for each core and more is read by enough tasks whatever its files look like.
ENOUGH_ROWS = 4_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly when fewer tasks than cores would hold its rows.

    A file with one row group is read by one task, and work that costs much per row then runs on one core. The rows of each
    task are counted without reading a column; a table that many tasks share is handed on as it is, so texts of a large input are never
    moved. For scans and what is derived from them row by row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("_tw_part")).groupBy("_tw_part").agg(F.count("*").alias("_tw_n"))
    most, total = held.agg(F.max("_tw_n"), F.sum("_tw_n")).first()
    if not total or total >= ENOUGH_ROWS * cores or most * cores <= 2 * total:
        return df
    return df.repartition(cores)


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path under the scratch folder that ``release_staged`` will delete."""
    path = scratch_path(spark, label)
    _staged.append(path)
    return path


def release_staged(spark: SparkSession) -> int:
    """Delete what this process has staged so far; for use once the results built on it are written."""
    count = 0
    while _staged:
        target = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        count += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return count
