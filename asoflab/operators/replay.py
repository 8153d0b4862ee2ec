"""Replay inputs: several as-of sides in one shuffle, histories and filled futures on a calendar, readiness by bitmaps of dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_many(left: DataFrame, rights: Mapping[str, tuple[DataFrame, str, Sequence[str]]], on: str, at: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """left with, for each name of rights, the newest right row at or before the row's time as a struct (NULL if none).

    rights: name -> (frame, time column, tie-break columns). All sides are united and cross one shuffle by ``on``; each
    side's last row is carried forward in the same order. A row that comes at the same time counts. ``extra``: columns over
    windows by ``on``, computed on left's rows in the same partitions; they need no further shuffle.
    """
    sides = [left.select(F.col(on), F.col(at).alias("_time"), F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c != on]).alias("_left"))]
    ties = max((len(t) for _, _, t in rights.values()), default=0)
    sides[0] = sides[0].withColumns({f"_tie{k}": F.lit(None).cast("string") for k in range(ties)})
    for name, (frame, time, tie) in rights.items():
        own = [f"lpad(cast({c} as string), 20, '0')" if dict(frame.dtypes)[c] in ("int", "bigint", "smallint") else f"cast({c} as string)" for c in tie]
        part = frame.where(F.col(time).isNotNull()).select(F.col(on), F.col(time).alias("_time"), F.lit(0).alias("_side"), F.struct(*[c for c in frame.columns if c != on]).alias(name), *[F.expr(e).alias(f"_tie{k}") for k, e in enumerate(own)])
        sides.append(part)
    united = sides[0]
    for s in sides[1:]:
        united = united.unionByName(s, allowMissingColumns=True)
    by = Window.partitionBy(on).orderBy(F.col("_time").asc_nulls_first(), "_side", *[F.col(f"_tie{k}").asc_nulls_first() for k in range(ties)]).rowsBetween(Window.unboundedPreceding, 0)
    carried = united.withColumns({name: F.last(name, ignorenulls=True).over(by) for name in rights}).where("_side = 1")
    # the key itself, not a copy from the struct: what follows by it stays in these partitions
    out = carried.select(*[F.col(on) if c == on else F.col(f"_left.{c}") for c in left.columns], *rights)
    return out.withColumns(dict(extra)) if extra else out


def session_arrays(symbol: str = "symbol", index: str = "trade_index", ahead: int = 21) -> dict[str, Column]:
    """Columns over a grid of all sessions: ``ahead`` holds the next sessions, those without a bar at the last close before them."""
    by = Window.partitionBy(symbol).orderBy(index)
    before = F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    filled = F.struct("trade_date", F.coalesce("close", before).alias("close"), F.coalesce("high", before).alias("high"), F.coalesce("low", before).alias("low"), F.col("close").isNull().alias("suspended"))
    return {"_filled": filled, "ahead": F.collect_list("_filled").over(by.rowsBetween(1, ahead))}


def replay_inputs(grid: DataFrame, rights: Mapping[str, tuple[DataFrame, str, Sequence[str]]], history: int = 60, ahead: int = 21) -> DataFrame:
    """One row for each observed bar of grid(symbol, trade_index, trade_date, open, high, low, close): its last ``history`` bars, its
    next ``ahead`` sessions with gaps filled, and the last row of each of rights. All of it crosses one shuffle by symbol."""
    told = asof_many(grid, rights, "symbol", "trade_date")
    for name, column in session_arrays(ahead=ahead).items():
        told = told.withColumn(name, column)
    seen = told.drop("_filled").where("close IS NOT NULL")
    past = Window.partitionBy("symbol").orderBy("trade_index").rowsBetween(-(history - 1), 0)
    return seen.withColumn("history", F.collect_list(F.struct("trade_date", "close")).over(past))


def with_returns(rows: DataFrame, series: DataFrame, name: str, sessions: int, keys: Sequence[str] = ()) -> DataFrame:
    """rows(trade_index, keys) with the return of series(keys, trade_index, level) over the next ``sessions``; series has a row for
    each session (and key, as an industry) and is small, so its own lead is taken first and it is broadcast."""
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("trade_index").rangeBetween(sessions, sessions)
    later = F.max("level").over(by)
    own = series.select(*keys, "trade_index", F.try_divide(later, F.nullif(F.col("level"), F.lit(0.0))).alias("_later"))
    return rows.join(F.broadcast(own), [*keys, "trade_index"], "left").withColumn(name, F.col("_later") - 1).drop("_later")


def date_bitmaps(days: DataFrame, keys: Sequence[str], place: str = "trade_index") -> DataFrame:
    """(keys, bucket, bits): the places, from 1, that each key has, 32,768 to a bucket; combined before the shuffle."""
    return days.where(F.col(place).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def readiness(registry: DataFrame, complete: DataFrame, calendar: DataFrame) -> DataFrame:
    """(feature, sources, required, covered, ready, missing) of registry(feature, source): ready if every calendar date is complete
    for each of its sources; missing lists the other dates in order.

    complete(source, trade_index) and calendar(trade_date, trade_index). A division of relations without a grid: the bitmaps of a
    feature's sources are ANDed, and only counted and read bit by bit.
    """
    nothing = F.unhex(F.repeat(F.lit("00"), 4096))
    have = date_bitmaps(complete, ["source"])
    need = date_bitmaps(calendar, []).select("bucket", F.col("bits").alias("need"))
    days = calendar.groupBy(F.bitmap_bucket_number("trade_index").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(F.bitmap_bit_position("trade_index").alias("bit"), "trade_date"))).alias("days"))
    asked = registry.distinct().join(F.broadcast(need), how="cross").join(have, ["source", "bucket"], "left")  # buckets of 32,768 dates
    both = asked.groupBy("feature", "bucket").agg(F.count("*").alias("sources"), F.bitmap_and_agg(F.coalesce("bits", nothing)).alias("bits"))
    open_ = "filter(days, d -> ((cast(conv(hex(substring(bits, cast(d.bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(d.bit % 8 as int)) & 1) = 0)"
    part = both.join(F.broadcast(days), "bucket").withColumn("open", F.expr(open_))
    out = part.groupBy("feature").agg(F.max("sources").alias("sources"), F.sum(F.size("days")).alias("required"), F.sum(F.size("days") - F.size("open")).alias("covered"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "open"))), lambda x: x["open"])).alias("open"))
    return out.select("feature", "sources", "required", "covered", (F.col("required") == F.col("covered")).alias("ready"), F.transform("open", lambda d: d["trade_date"]).alias("missing"))


def window_coverage(bars: DataFrame, calendar: DataFrame, spans: Sequence[int], dead: int) -> DataFrame:
    """(symbol, seen_n, complete_n for each of spans, sessions, is_new, long_suspended): the last n sessions that each symbol has,
    as bitmaps from one pass; new ones have fewer sessions since their first than the longest span, long suspended none of the last ``dead``."""
    last = calendar.agg(F.max("trade_index")).first()[0]  # one number
    back = F.lit(last) - F.col("trade_index") + 1  # 1 is the last session
    placed = bars.join(F.broadcast(calendar.select("trade_date", "trade_index")), "trade_date").withColumn("back", back)
    bits = lambda n: F.bitmap_count(F.bitmap_construct_agg(F.when(F.col("back") <= n, F.bitmap_bit_position("back"))))
    out = placed.groupBy("symbol").agg(*[bits(n).alias(f"seen_{n}") for n in spans], F.max("back").alias("sessions"), bits(dead).alias("_alive"))
    return out.select("symbol", *[F.col(f"seen_{n}") for n in spans], *[(F.col(f"seen_{n}") == min(n, last)).alias(f"complete_{n}") for n in spans], "sessions", (F.col("sessions") < max(spans)).alias("is_new"), (F.col("_alive") == 0).alias("long_suspended"))
