"""Databases and external partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.operators.changes import replace_ids


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")


def register_table(
    spark: SparkSession, database: str, table: str, schema: T.StructType, location: str, partition_keys: Sequence[str]
) -> None:
    """Create or update an external partitioned Parquet table.

    Updating drops and recreates the entry; the files stay, since the table is external.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    keys = ", ".join(f"`{k}`" for k in partition_keys)
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")
    spark.sql(
        f"CREATE TABLE `{database}`.`{table}` ({columns}) USING PARQUET "
        f"PARTITIONED BY ({keys}) LOCATION '{location}'"
    )


def repair_partitions(spark: SparkSession, database: str, table: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE `{database}`.`{table}`")


def scan_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    return spark.table(f"`{database}`.`{table}`")


def list_partitions(spark: SparkSession, database: str, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS `{database}`.`{table}`")


def replace_table_with_id(
    df: DataFrame, database: str, table: str, order: Sequence[Column], name: str = "id", path: str | None = None
) -> None:
    """Replace a table by ``df`` with a 0-based id over a stated order."""
    writer = replace_ids(df, order, name).select(name, *df.columns).write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(f"`{database}`.`{table}`")
