"""Landing of raw rows: payload extraction, error codes, reconciliation of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import close_enough, ratio


def extracted(payload: str, spec: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Columns of a JSON payload by {name: (path, type)}; what doesn't parse or convert is NULL."""
    return {name: F.get_json_object(payload, path).try_cast(kind) for name, (path, kind) in spec.items()}


def coded(rows: DataFrame, checks: dict[str, Column], keys: Sequence[str], order: Sequence[Column], duplicate: str = "DUPLICATE_SYMBOL") -> DataFrame:
    """rows with error_code: the first check that holds, then ``duplicate`` for later rows of a key, else NULL."""
    by = Window.partitionBy(*keys).orderBy(*order)
    code = None
    for name, holds in checks.items():
        code = F.when(holds, F.lit(name)) if code is None else code.when(holds, F.lit(name))
    return rows.withColumn("_row", F.row_number().over(by)).withColumn("error_code", code.when(F.col("_row") > 1, F.lit(duplicate))).drop("_row")


def landed(rows: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, quarantined rows with their code, counts by code)."""
    every = coded(rows, *args, **kwargs)
    bad = every.where("error_code IS NOT NULL")
    return every.where("error_code IS NULL").drop("error_code"), bad, bad.groupBy("error_code").agg(F.count("*").alias("n"))


def reconciled(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: dict[str, tuple[float, float]]) -> DataFrame:
    """(keys, field, a, b, difference, relative, matched): every row of a against b, by field with (absolute, relative) tolerance."""
    wide = a.select(*keys, *[F.col(f).cast("double").alias(f"a_{f}") for f in fields]).join(b.select(*keys, *[F.col(f).cast("double").alias(f"b_{f}") for f in fields]), list(keys), "left")
    parts = [F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b"), close_enough(f"a_{f}", f"b_{f}", *tol).alias("matched")) for f, tol in fields.items()]
    long = wide.select(*keys, F.explode(F.array(*parts)).alias("x")).select(*keys, "x.*")
    return long.withColumn("difference", F.col("b") - F.col("a")).withColumn("relative", ratio(F.col("b") - F.col("a"), F.abs("a")))
