"""Point-in-time reads: revisions, as-of and interval joins, calendar grids, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_revision(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must end in a tie-break."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(by)).where("_row = 1").drop("_row")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(by)).where(F.col("_row") <= n).drop("_row")


def with_trade_index(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """bars with trade_index, the date's place in the calendar (by default the bars' own dates)."""
    days = calendar if calendar is not None else trading_days(bars)
    return bars.join(F.broadcast(days.select("trade_date", "trade_index")), "trade_date")  # a row for each day


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct dates with their index and neighbours. One row for each day, so one partition is enough."""
    by = Window.orderBy("trade_date")
    days = bars.select("trade_date").distinct()
    return days.select("trade_date", F.row_number().over(by).alias("trade_index"), F.lag("trade_date").over(by).alias("previous_date"), F.lead("trade_date").over(by).alias("next_date"))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the newest right row at or before its time (struct column ``asof``, NULL if none).

    One shuffle: both sides are united and the last right row is carried forward.
    """
    payload = [c for c in right.columns if c not in on]
    r = right.where(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in (right_time, *tie)]).alias("_tie"), F.struct(*payload).alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    l = left.select(*on, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    by = Window.partitionBy(*on).orderBy(F.col("_time").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = r.unionByName(l).withColumn("asof", F.last("_right", ignorenulls=True).over(by))
    return carried.where("_side = 1").select("_left.*", "asof")


def interval_join(left: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str, how: str = "inner", closed: bool = True) -> DataFrame:
    """Rows of left with the intervals that cover their date; an open end is NULL. Always equi on a key."""
    i = intervals.withColumnRenamed(on, "_key")
    before_end = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    covers = (F.col(on) == F.col("_key")) & (F.col(at) >= F.col(start)) & (F.col(end).isNull() | before_end)
    out = left.join(i, covers, how)
    return out.drop("_key") if how not in ("left_semi", "left_anti") else out


def covering(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str, counts: Mapping[str, Column]) -> DataFrame:
    """(on, at, each of counts): how many of the intervals that cover a date fulfil a condition; dates that none covers are left out.

    What ``interval_join`` and a grouping would tell, without a row for each pair: intervals add 1 on their first day and take it
    back after their last, in one sort of a key's days. Points may repeat; an open end is NULL, ends are covered.
    """
    held = {"_n": F.lit(1)} | {c: F.when(x, 1).otherwise(0) for c, x in counts.items()}
    i = intervals.where(F.col(start).isNotNull() & F.col(on).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    opened = i.select(on, F.col(start).alias(at), F.lit(0).alias("_side"), *[x.alias(c) for c, x in held.items()])
    closed = i.where(F.col(end).isNotNull()).select(on, F.date_add(end, 1).alias(at), F.lit(0).alias("_side"), *[(-x).alias(c) for c, x in held.items()])
    p = points.where(F.col(at).isNotNull() & F.col(on).isNotNull()).select(on, at, F.lit(1).alias("_side"), *[F.lit(0).alias(c) for c in held])
    by = Window.partitionBy(on).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    told = p.unionByName(opened).unionByName(closed).select(on, at, "_side", *[F.sum(c).over(by).alias(c) for c in held], (~F.struct("_side", at).eqNullSafe(F.lag(F.struct("_side", at)).over(Window.partitionBy(on).orderBy(at, "_side")))).alias("_first"))
    return told.where("_side = 1 AND _first AND _n > 0").select(on, at, *counts)


def pit_membership(rows: DataFrame, memberships: DataFrame, row_id: Sequence[str], at: str, cutoff: str) -> DataFrame:
    """Each row with the membership valid at its date and known by its cutoff: newest valid_from, then availability, then id.

    memberships(symbol, valid_from, valid_to, available, membership_id, ...); no membership leaves NULLs.
    """
    m = memberships.withColumnRenamed("symbol", "_key")
    known = (F.col("symbol") == F.col("_key")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col(at))) & (F.col("available") <= F.col(cutoff))
    order = [F.col("valid_from").desc_nulls_last(), F.col("available").desc_nulls_last(), F.col("membership_id").desc_nulls_last()]
    return latest_revision(rows.join(m, known, "left").drop("_key"), row_id, order)


def dense_grid(symbols: DataFrame, calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """symbols x calendar with the bars that are there. The calendar is small: a row for each day."""
    return symbols.crossJoin(F.broadcast(calendar)).join(bars, ["symbol", "trade_date"], "left")


def prefer_with_fallback(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of new, and the rows of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(new.columns))


def append_new(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df to append to target: one of each key that target lacks."""
    return df.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def merge_by_hash(df: DataFrame, target: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """df's rows as NEW, CHANGED or UNCHANGED against target, and target's other rows as KEPT; values are the winner's."""
    rest = [c for c in df.columns if c not in keys]
    a = df.select(*keys, F.struct(*rest).alias("_new"))
    b = target.select(*keys, F.struct(*rest).alias("_old"))
    same = F.col(f"_new.{hash_col}").eqNullSafe(F.col(f"_old.{hash_col}"))
    state = F.when(F.col("_new").isNull(), "KEPT").when(F.col("_old").isNull(), "NEW").when(same, "UNCHANGED").otherwise("CHANGED")
    out = a.join(b, list(keys), "full").withColumn("state", state)
    winner = F.when(F.col("state").isin("NEW", "CHANGED"), F.col("_new")).otherwise(F.col("_old"))
    return out.withColumn("_row", winner).select(*keys, "_row.*", "state")


def last_write_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Upsert of every column: the newest stamp of each key; of equal stamps, new's."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return latest_revision(both, keys, [F.col(stamp).desc_nulls_last(), F.col("_side").desc()]).drop("_side")


def pending_dates(calendar: DataFrame, checkpoints: DataFrame, forced: Sequence = ()) -> DataFrame:
    """Dates without a COMPLETE checkpoint, and the forced ones."""
    done = checkpoints.where("status = 'COMPLETE'").select("trade_date")
    again = calendar.where(F.col("trade_date").isin(*forced)) if forced else calendar.limit(0)
    return calendar.join(done, "trade_date", "left_anti").unionByName(again).select("trade_date").distinct()


def incremental_build(bars: DataFrame, calendar: DataFrame, checkpoints: DataFrame, build, target: str, log: str, forced: Sequence = ()) -> int:
    """Builds pending dates into date partitions of ``target`` and logs them as COMPLETE with count and hash; returns how many."""
    todo = pending_dates(calendar, checkpoints, forced)
    out = build(bars.join(F.broadcast(todo), "trade_date", "left_semi")).persist()
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(target)
    done = out.groupBy("trade_date").agg(F.count("*").alias("n"), F.xxhash64(F.sort_array(F.collect_list(F.xxhash64(*[c for c in out.columns if c != "trade_date"])))).alias("digest"))
    done.withColumn("status", F.lit("COMPLETE")).write.mode("append").parquet(log)
    n = done.count()
    out.unpersist()
    return n


def retained(comments: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Comments younger than their source's ttl_days; no or non-positive ttl keeps them."""
    joined = comments.join(sources.select("source_id", "ttl_days"), "source_id", "left")
    keep = F.col("ttl_days").isNull() | (F.col("ttl_days") <= 0) | (F.col("fetched_on") >= F.date_sub(now, F.col("ttl_days")))
    return joined.where(keep).drop("ttl_days")


def violations(df: DataFrame, cutoff: str, available: Sequence[str], signal: str | None = None, entry: str | None = None) -> DataFrame:
    """Counts of rows that know the future: availabilities behind the cutoff, entries not after the signal."""
    checks = [F.count_if(F.col(a) > F.col(cutoff)).alias(f"late_{a}") for a in available]
    if signal and entry:
        checks.append(F.count_if(F.col(entry) <= F.col(signal)).alias("early_entries"))
    return df.agg(F.count("*").alias("n"), *checks)
