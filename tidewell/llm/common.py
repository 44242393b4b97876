"""What the corpus operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import staged_path

#: Rows in one Arrow batch: texts may be long, so fewer than the default of 10,000.
BATCH_ROWS = 500

#: Settings of every query of this folder.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}

#: Files a core for small tables of links and components, and for tables that grow with the documents.
FEW, SOME = 2, 8

#: White space of all word definitions here: \x20 and \x09 to \x0D, as in Python's bytes.split.
SPACE = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; ``release_staged`` deletes it."""
    return staged_path(spark, label)


def written(df: DataFrame, label: str, few: int = 0, **options) -> str:
    """Write to a new folder; the folder. ``few``: the result of a shuffle that may have many small partitions, in at most so many files a core."""
    path = fresh_folder(df.sparkSession, label)
    if few:
        df = df.coalesce(few * df.sparkSession.sparkContext.defaultParallelism)
    df.write.options(compression="zstd", **options).parquet(path)
    return path


def write_and_read(df: DataFrame, label: str, few: int = 0) -> DataFrame:
    """Write and read back: no lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label, few))


def size_checked(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows; looks at no more than that many and one."""
    return df.limit(max_rows + 1).count() <= max_rows


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]
