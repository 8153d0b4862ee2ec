"""Event clusters kept up to date batch by batch, whatever order reports come in.

Each micro-batch appends what it adds, under its batch number: its records, and the (id, cluster) rows that changed. A batch
that is run again after an interruption replaces its own part and reads only earlier ones, so it ends as if it had run once.
A late report may bridge clusters; they take the smallest id then, and so do their members. Only records that share a
title or content with the batch within the window are looked at, and only members of clusters that changed are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import normalised_text
from asoflab.operators.evaluate import components
from asoflab.operators.news import cluster_links
from asoflab.sources import shared

RECORDS = "id long, type string, ts timestamp, title string, content_hash string, symbols array<string>, batch long"
LABELS = "id long, cluster long, batch long"


def _stored(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """Rows of earlier batches; a partition for each batch, so later parts aren't read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch") < before)


def _append(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def current_labels(spark: SparkSession, folder: str, before: int = 1 << 62) -> DataFrame:
    """(id, cluster): the newest label of each record."""
    rows = _stored(spark, f"{folder}/labels", LABELS, before)
    return rows.groupBy("id").agg(F.max_by("cluster", "batch").alias("cluster"))


def add_batch(records: DataFrame, batch: int, folder: str, hours: int = 24) -> None:
    """Adds records(id, type, ts, title, content_hash, symbols) of one micro-batch; a known id is left as it was first told."""
    spark = records.sparkSession
    shared.checkpoint_dir(spark)
    old = _stored(spark, f"{folder}/records", RECORDS, batch).drop("batch")
    order = Window.partitionBy("id").orderBy("ts", F.xxhash64("type", "title", "content_hash"))
    new = records.select("id", "type", F.col("ts").cast("timestamp").alias("ts"), "title", "content_hash", "symbols").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    new = new.join(old.select("id"), "id", "left_anti").checkpoint()
    _append(new, f"{folder}/records", batch)
    labels = current_labels(spark, folder, batch)

    def keys(df: DataFrame) -> DataFrame:
        marks = F.array(F.concat(F.lit("t"), normalised_text("title")), F.concat(F.lit("c"), F.col("content_hash")))
        return df.where("ts IS NOT NULL").select("id", "ts", "type", F.explode(marks).alias("mark")).where("mark IS NOT NULL")

    spans = keys(new).groupBy("type", "mark").agg((F.unix_timestamp(F.min("ts")) - hours * 3600).alias("low"), (F.unix_timestamp(F.max("ts")) + hours * 3600).alias("high"))
    met = keys(old).join(spans, ["type", "mark"]).where(F.unix_timestamp("ts").between(F.col("low"), F.col("high") + 1)).select("id").distinct()
    near = old.join(met, "id", "left_semi").unionByName(new)
    owners = met.join(labels, "id")
    edges = cluster_links(near, hours).unionByName(owners.select(F.col("id").alias("a"), F.col("cluster").alias("b")).where("a <> b")).distinct()
    nodes = near.select("id").union(owners.select("cluster")).distinct().select(F.col("id").alias("node"))
    found = components(edges, nodes)
    renamed = owners.select("cluster").distinct().join(found, F.col("cluster") == F.col("node")).where("component <> cluster").select("cluster", "component")
    moved = labels.join(renamed, "cluster").select("id", F.col("component").alias("cluster"))
    fresh = new.select("id").join(found, F.col("id") == F.col("node")).select("id", F.col("component").alias("cluster"))
    _append(fresh.unionByName(moved), f"{folder}/labels", batch)


def clustered(records: DataFrame, folder: str, checkpoint: str, hours: int = 24):
    """A writer that keeps the clusters of a stream of records in folder; start it with a trigger."""
    return records.writeStream.foreachBatch(lambda df, k: add_batch(df, k, folder, hours)).option("checkpointLocation", checkpoint)
