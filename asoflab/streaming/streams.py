"""Structured Streaming forms of polled snapshots, event upserts and running positions.

Event time comes from column ``ts``; rows later than the watermark are dropped by
the stateful operators, as Structured Streaming defines it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_quotes(quotes: DataFrame, key: str = "symbol") -> DataFrame:
    """The newest row of each key so far; update or complete mode. Readers see whole batches."""
    rest = [c for c in quotes.columns if c != key]
    return quotes.groupBy(key).agg(F.max(F.struct("ts", *[c for c in rest if c != "ts"])).alias("q")).select(key, "q.*")


def freshness(age_seconds, fresh: int = 145, degraded: int = 290):
    """FRESH, DEGRADED or STALE by the age of the newest quote."""
    return F.when(age_seconds <= fresh, "FRESH").when(age_seconds <= degraded, "DEGRADED").otherwise("STALE")


def distinct_content(rows: DataFrame, content: str, delay: str = "1 hour") -> DataFrame:
    """One row of each content hash within the watermark."""
    return rows.withColumn("content_hash", F.sha2(F.col(content).cast("string"), 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def event_upserts(events: DataFrame, key: str) -> DataFrame:
    """Reports of an event so far: count, first and last time, distinct sources."""
    return events.groupBy(key).agg(F.count("*").alias("reports"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_set("source")).alias("sources"))


def event_sessions(events: DataFrame, keys: list[str], gap: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Clusters of events of a key that follow each other within the gap."""
    return events.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, keys: list[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling (or sliding) event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def running_positions(trades: DataFrame) -> DataFrame:
    """Quantity, average cost and realised gain of each (portfolio, symbol) after each micro-batch.

    trades(portfolio, symbol, ts, trade_id, side, quantity, price); a batch is folded in order of time and id.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, cost, gain = state.get if state.exists else (0.0, 0.0, 0.0)
        for r in pd.concat(list(frames)).sort_values(["ts", "trade_id"]).itertuples():
            x = r.quantity if r.side == "BUY" else -r.quantity
            new = q + x
            if q * x >= 0:
                cost = (q * cost + x * r.price) / new if new else 0.0
            else:
                gain += min(abs(q), abs(x)) * (r.price - cost) * (1 if q > 0 else -1)
                cost = 0.0 if new == 0 else cost if q * new > 0 else r.price
            q = new
        state.update((q, cost, gain))
        yield pd.DataFrame({"portfolio": [key[0]], "symbol": [key[1]], "quantity": [q], "average_cost": [cost], "realised": [gain]})

    return trades.groupBy("portfolio", "symbol").applyInPandasWithState(fold, "portfolio long, symbol long, quantity double, average_cost double, realised double", "q double, cost double, gain double", "update", GroupStateTimeout.NoTimeout)


def by_batch(rows: DataFrame, work, checkpoint: str):
    """Runs work(batch frame, batch id) on each micro-batch; it resumes from the checkpoint after an interruption."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
