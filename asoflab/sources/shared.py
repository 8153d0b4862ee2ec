"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all of Spark is this process, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="asoflab-"))
    return _own[0]


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes checkpoint() usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder(spark))


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df once, compressed, to the shared folder and reads it back."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from its checkout."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *parts] if x)
