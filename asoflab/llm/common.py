"""What several operators of this subpackage share.

Nothing here is bound to a table: checkpointed tables, connected components,
and the deterministic held-out split.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asoflab.sources import shared

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from its checkout."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *parts] if x)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of a local session, or an error on a cluster."""
    return shared.folder(spark)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here,
    and an executor that is lost later costs a re-read, not a re-computation."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def bounded_sample(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of ids(doc_id, ...) with the smallest hash of their id; all of them if there are fewer.

    Only ids travel, and of those only about as many as are wanted.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    n = ids.count()
    share = 1_000_000 if n <= 4 * most else int(1_000_000 * most / n * 1.5) + 100
    return ids.where(place < share).orderBy(place, F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node reached.

    Minimum labels travel over the edges, then each label is replaced by its own
    label (pointer jumping), so long chains close in a logarithmic number of
    rounds. Each round is two written tables; hubs are handled by partial
    aggregation and by joins that adaptive execution may split.
    """
    pairs = edges.where("a <> b")
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = written(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), "hooked")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = written(hooked.join(up, "component").select("node", F.col("up").alias("component"), "was"), "jumped")
        labels = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def global_places(table: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """A written table's rows with their place, from 1, in the order of all rows; no task gets more than its range.

    Rows are sorted by ranges and written; only the number of rows of each range travels.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    ranged = written(table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).withColumn("_at", at), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select("_part", "_first", before.alias("_before"))
    placed = ranged.join(F.broadcast(ranges), "_part")  # a row for each partition
    return placed.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def places_of(table: DataFrame, key: str, order: list[Column], name: str = "place") -> DataFrame:
    """A written table's rows with their place, from 1, among those of equal key (not null); a hot key spreads over many ranges."""
    every = [F.col(key), *order, F.monotonically_increasing_id()]  # equal rows may be cut apart as well
    spread = table.withColumn("_salt", every[-1])
    every[-1] = F.col("_salt")
    ranged = written(spread.repartitionByRange(*every).sortWithinPartitions(*every).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).drop("_salt"), "ranges")
    counts = written(ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "range-counts")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(key, "_part", "_first", before.alias("_before"))
    placed = ranged.join(counts, [key, "_part"])
    return placed.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")
