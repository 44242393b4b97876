"""File scans and sinks: delimited text, JSON lines, Parquet, reports, markers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 32 * 1024 * 1024
# text files keep microseconds; the default formats stop at milliseconds
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", header: bool = True
) -> DataFrame:
    """Delimited scan. Without a schema the types are inferred, at the cost of one more pass."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.options(**TIME_FORMATS).schema(schema).csv(path)


def read_indexed_ssv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Semicolon-separated scan whose first column is a row index, which is dropped."""
    indexed = T.StructType([T.StructField("_tw_index", T.StringType()), *schema.fields])
    return read_delimited(spark, path, indexed, sep=";").drop("_tw_index")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed records, and the lines that are not valid JSON.

    The lines are read as text and parsed once each, so good and bad lines come from
    the same scan without caching it.
    """
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", **TIME_FORMATS}
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        "value",
        F.from_json("value", marked, options).alias("r"),
    )
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.where(~bad).select(*(F.col(f"r.`{n}`").alias(n) for n in schema.names))
    return good, parsed.where(bad).select("value")


def split_shapes(log: DataFrame, column: str = "type", value: str = "reward") -> tuple[DataFrame, DataFrame]:
    """The two record shapes of one log: everything else, and the records of the given type."""
    is_value = F.coalesce(F.col(column) == value, F.lit(False))
    return log.where(~is_value), log.where(is_value)


def flatten_quote_columns(df: DataFrame) -> DataFrame:
    """Two-level column names such as ``('Close', '^X')`` become their first level."""
    names = {}
    for name in df.columns:
        match = re.match(r"^\(\s*'([^']*)'\s*,", name)
        if match:
            names[name] = match.group(1)
    return df.withColumnsRenamed(names)


def write_partitioned(df: DataFrame, path: str, partition: str, incremental: bool = False) -> None:
    """Parquet, one directory per partition value.

    Rows are first gathered by partition value so a small one is one file; a rebalance
    splits a value that holds far more rows than the others. ``incremental`` replaces
    only the partitions present in ``df``.
    """
    mode = "dynamic" if incremental else "static"
    (
        df.hint("rebalance", partition).write.mode("overwrite")
        .option("partitionOverwriteMode", mode).partitionBy(partition).parquet(path)
    )


def write_delimited(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """CSV with header. ``single_file`` sends everything through one task: small outputs only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**TIME_FORMATS).option("header", True).option("sep", sep).csv(path)


def write_two_copies(df: DataFrame, first: str, second: str) -> None:
    """The same CSV under two names; the copy is made from the first file, not recomputed."""
    write_delimited(df, first)
    write_delimited(read_delimited(df.sparkSession, first, df.schema), second)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    mode = "append" if append else "overwrite"
    df.write.mode(mode).options(**TIME_FORMATS).option("ignoreNullFields", False).json(path)


def write_report(document: DataFrame, path: str) -> None:
    """A one-column table of JSON documents as a text file."""
    document.coalesce(1).write.mode("overwrite").text(path)


def plan_size(df: DataFrame) -> int:
    """Size in bytes that Spark's own statistics give for the table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only when the statistics prove the table small."""
    return F.broadcast(df) if plan_size(df) <= limit else df


_dimensions: dict[tuple[str, str], DataFrame] = {}


def cached_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A small reference table kept in memory for the application; a larger one is read anew at each use.

    ``forget_dimension`` frees it, for example after the table has changed.
    """
    slot = (spark.sparkContext.applicationId, path)
    if slot not in _dimensions:
        table = spark.read.parquet(path)
        if plan_size(table) > BROADCAST_LIMIT:
            return table
        _dimensions[slot] = table.cache()
    return F.broadcast(_dimensions[slot])


def forget_dimension(spark: SparkSession, path: str) -> None:
    kept = _dimensions.pop((spark.sparkContext.applicationId, path), None)
    if kept is not None:
        kept.unpersist()


def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, target = _file(spark, path)
    return bool(files.exists(target))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of superseded state, if it is there."""
    files, target = _file(spark, path)
    files.delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, target = _file(spark, path)
    return [str(f.getPath().getName()) for f in files.listStatus(target)] if files.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of state, read by the driver."""
    files, target = _file(spark, path)
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all; one that is there already is not replaced."""
    files, target = _file(spark, path)
    _, draft = _file(spark, f"{path}.{uuid.uuid4().hex}.draft")
    files.mkdirs(target.getParent())
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise FileExistsError(path)


def mark_complete(spark: SparkSession, folder: str, marker: str) -> None:
    """Leave an empty marker file, to be called after a stage's write has returned."""
    files, target = _file(spark, f"{folder}/{marker}")
    files.create(target, True).close()


def is_complete(spark: SparkSession, folder: str, marker: str) -> bool:
    return folder_exists(spark, f"{folder}/{marker}")


def read_when_complete(spark: SparkSession, folder: str, marker: str, schema: T.StructType) -> DataFrame:
    """The stage's output once its marker is there; before that an empty table."""
    if not is_complete(spark, folder, marker):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def with_index_column(df: DataFrame, index: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Put a leading index column, as spreadsheets exports carry one."""
    return df.select(index.alias("_c0"), *(columns or df.columns))
