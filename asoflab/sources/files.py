"""Readers and writers of files: schemas are given, never inferred from all data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_sources(spark: SparkSession, paths: dict[str, str]) -> None:
    """Temporary views of several Parquet stores, by alias."""
    for alias, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(alias)


def from_rows(spark: SparkSession, rows: Sequence, schema: str, view: str | None = None) -> DataFrame:
    df = spark.createDataFrame(list(rows), schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def replace_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Creates or replaces a table; partitions by the given columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A report-sized table as one CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def audit_rows(items: DataFrame, plan: str, keys: Sequence[str]) -> DataFrame:
    """items with run_id, the hash of the plan and of the item's key: appending twice adds nothing (see pit.append_new)."""
    key = F.concat_ws("|", F.lit(plan), *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return items.withColumn("run_id", F.concat(F.lit("run_"), F.substring(F.sha2(F.lit(plan), 256), 1, 32))).withColumn("item_id", F.concat(F.lit("item_"), F.substring(F.sha2(key, 256), 1, 32)))
