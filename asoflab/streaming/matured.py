"""Forward labels of observations as soon as their horizon has passed, from one stream of observations and bars.

Both kinds of rows come as one stream ``events(symbol, ts, kind, id, close, high, low)``: kind OBSERVATION has an id and the
close it was made at, kind BAR a session's prices. A label of horizon h needs the first h bars after the observation; it is
final, and told once, when the watermark has passed the h-th of them, so a bar that comes late but within the delay still
counts and one that comes later doesn't. State of a symbol: its observations that lack labels, and the bars that they still
need. ``matured_batch`` states the same on tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HORIZONS = (1, 3, 5, 10, 20)
LABELS = "symbol long, id long, horizon int, observed timestamp, exit_ts timestamp, ret double, mae double, mfe double"
STATE = "ids array<long>, seen array<long>, closes array<double>, told array<int>, times array<long>, bars array<double>"


def union_stream(observations: DataFrame, bars: DataFrame) -> DataFrame:
    """events of observations(symbol, ts, id, close) and bars(symbol, ts, close, high, low)."""
    nothing = F.lit(None).cast("double")
    a = observations.select("symbol", "ts", F.lit("OBSERVATION").alias("kind"), "id", "close", nothing.alias("high"), nothing.alias("low"))
    b = bars.select("symbol", "ts", F.lit("BAR").alias("kind"), F.lit(None).cast("long").alias("id"), "close", "high", "low")
    return a.unionByName(b)


def matured(events: DataFrame, delay: str = "2 days", horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Labels (symbol, id, horizon, observed, exit_ts, ret, mae, mfe) of a stream of events, in append mode."""
    steps = sorted(horizons)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, bars = {}, {}
        if state.exists:
            ids, seen, closes, told, times, prices = state.get
            pending = {i: (t, c, n) for i, t, c, n in zip(ids, seen, closes, told, strict=True)}
            bars = {t: tuple(prices[3 * k : 3 * k + 3]) for k, t in enumerate(times)}
        if not state.hasTimedOut:
            for f in frames:
                stamps = f["ts"].astype("datetime64[us]").astype("int64")
                for t, kind, i, close, high, low in zip(stamps, f["kind"], f["id"], f["close"], f["high"], f["low"], strict=True):
                    if kind == "BAR":
                        bars[int(t)] = (float(close), float(high), float(low))
                    else:
                        pending.setdefault(int(i), (int(t), float(close), 0))
        passed = state.getCurrentWatermarkMs() * 1000
        order, out = sorted(bars), []
        for i, (t, close, done) in list(pending.items()):
            after = [x for x in order if x > t][: steps[-1]]
            while done < len(steps) and len(after) >= steps[done] and after[steps[done] - 1] <= passed:
                own = [bars[x] for x in after[: steps[done]]]
                out.append((key[0], i, steps[done], t, after[steps[done] - 1], own[-1][0] / close - 1, min(b[2] for b in own) / close - 1, max(b[1] for b in own) / close - 1))
                done += 1
            if done == len(steps):
                del pending[i]
            else:
                pending[i] = (t, close, done)
        # an observation may still come late, down to the watermark: bars after it are needed until then
        oldest = min([passed, *(t for t, _, _ in pending.values())])
        bars = {t: b for t, b in bars.items() if t > oldest}
        if pending or bars:
            kept = sorted(bars)
            state.update(([*pending], [x[0] for x in pending.values()], [x[1] for x in pending.values()], [x[2] for x in pending.values()], kept, [v for t in kept for v in bars[t]]))
            waiting = [t for t in kept if t > passed]
            if waiting:
                state.setTimeoutTimestamp(max(waiting[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        told_rows = pd.DataFrame(out, columns=["symbol", "id", "horizon", "observed", "exit_ts", "ret", "mae", "mfe"])
        for c in ("observed", "exit_ts"):
            told_rows[c] = pd.to_datetime(told_rows[c], unit="us")
        yield told_rows.astype({"symbol": "int64", "id": "int64", "horizon": "int32"})

    return events.withWatermark("ts", delay).groupBy("symbol").applyInPandasWithState(fold, LABELS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def matured_batch(observations: DataFrame, bars: DataFrame, horizons: Sequence[int] = HORIZONS, passed=None) -> DataFrame:
    """The same labels from tables: the h-th bar after each observation, and extremes up to it; ``passed`` is a time that the h-th bar must not exceed.

    One shuffle by symbol: observations and bars lie in one order, and an observation reads the bars that follow it.
    """
    events = union_stream(observations, bars)
    by = Window.partitionBy("symbol").orderBy(F.col("ts"), F.when(F.col("kind") == "BAR", 0).otherwise(1), "id")
    place = F.count(F.when(F.col("kind") == "BAR", 1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    placed = events.withColumn("place", place)
    bar = F.when(F.col("kind") == "BAR", F.struct("ts", "close", "high", "low"))
    # bars have consecutive places: those after an observation have the next places, whatever lies between
    ahead = Window.partitionBy("symbol").orderBy("place").rangeBetween(1, max(horizons))
    own = placed.withColumn("after", F.collect_list(bar).over(ahead)).where("kind = 'OBSERVATION'")
    one = own.select("symbol", "id", F.col("ts").alias("observed"), "close", F.array_sort("after").alias("after"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).where("size(after) >= horizon")
    used = F.slice("after", F.lit(1), F.col("horizon"))
    told = one.withColumns({"exit": F.col("after")[F.col("horizon") - 1], "low": F.array_min(F.transform(used, lambda b: b["low"])), "high": F.array_max(F.transform(used, lambda b: b["high"]))})
    out = told.select("symbol", "id", "horizon", "observed", F.col("exit.ts").alias("exit_ts"), (F.col("exit.close") / F.col("close") - 1).alias("ret"), (F.col("low") / F.col("close") - 1).alias("mae"), (F.col("high") / F.col("close") - 1).alias("mfe"))
    return out if passed is None else out.where(F.col("exit_ts") <= F.lit(passed))
