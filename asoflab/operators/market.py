"""Market, sector and capital aggregates: one row for each day, sector or symbol and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from asoflab.functions.columns import change, col, ratio


def days() -> WindowSpec:
    """Dates in order, without a partition: only over frames of one row for each day."""
    return Window.orderBy("trade_date")


def market_breadth(stock: DataFrame) -> DataFrame:
    """stock(trade_date, ret, amount, ...) as daily counts, shares, mean return, turnover and its change."""
    day = stock.groupBy("trade_date").agg(
        F.count("*").alias("members"), F.count("ret").alias("valid"), F.count_if(F.col("ret") > 0).alias("advancers"), F.count_if(F.col("ret") < 0).alias("decliners"),
        F.count_if(F.col("ret") == 0).alias("unchanged"), F.avg("ret").alias("mean_return"), F.sum("amount").alias("turnover"),
    )
    return day.withColumns({
        "advance_ratio": ratio("advancers", "valid"), "decline_ratio": ratio("decliners", "valid"), "strength": ratio(F.col("advancers") - F.col("decliners"), "valid"),
        "coverage": ratio("valid", "members"), "turnover_change": change("turnover", F.lag("turnover").over(days())),
    })


def breadth_with_limits(stock: DataFrame, limit: float = 0.095, n: int = 20) -> DataFrame:
    """Breadth with limit counts, broken boards, amount against its prior mean, and the longest limit-up streak.

    stock(symbol, trade_date, ret, high_ret, amount, limit_streak).
    """
    up = F.col("ret") >= limit
    touched = F.col("high_ret") >= limit
    day = stock.groupBy("trade_date").agg(
        F.count_if(up).alias("limit_up"), F.count_if(F.col("ret") <= -limit).alias("limit_down"), F.count_if(touched & ~up).alias("broken"),
        F.sum("amount").alias("amount"), F.sum(F.when(F.col("ret") > 0, F.col("amount"))).alias("amount_up"), F.max("limit_streak").alias("longest"),
    )
    prior = days().rowsBetween(-n, -1)
    return day.withColumns({"broken_rate": ratio("broken", F.col("broken") + F.col("limit_up")), "amount_ratio": F.when(F.count("amount").over(prior) == n, ratio("amount", F.avg("amount").over(prior))), "up_share": ratio("amount_up", "amount")})


def sector_snapshot(stock: DataFrame, by: str = "sector", top: int = 3) -> DataFrame:
    """stock(symbol, trade_date, <by>, ret, amount) by sector and day, with leader and top mean, relative to the day's mean return.

    The day's mean comes from the sectors' sums, so stock is read and shuffled once.
    """
    place = Window.partitionBy("trade_date", by).orderBy(F.col("ret").desc_nulls_last(), "symbol")
    ranked = stock.withColumn("_place", F.row_number().over(place))
    out = ranked.groupBy("trade_date", by).agg(
        F.count("*").alias("members"), F.count("ret").alias("observed"), F.count_if(F.col("ret") > 0).alias("advancers"), F.avg("ret").alias("mean_return"), F.percentile("ret", F.lit(0.5)).alias("median_return"),
        F.sum("amount").alias("amount"), F.max(F.when((F.col("_place") == 1) & F.col("ret").isNotNull(), F.col("symbol"))).alias("leader"), F.avg(F.when(F.col("_place") <= top, F.col("ret"))).alias("top_mean"), F.sum("ret").alias("_sum"),
    )
    day = Window.partitionBy("trade_date")
    return out.withColumn("relative", F.col("mean_return") - ratio(F.sum("_sum").over(day), F.sum("observed").over(day))).drop("_sum")


def concentration(stock: DataFrame, sizes: Sequence[int] = (10, 50), value: str = "amount") -> DataFrame:
    """Shares of each day's total that its largest symbols hold."""
    place = Window.partitionBy("trade_date").orderBy(F.desc(value), "symbol")
    ranked = stock.withColumn("_place", F.row_number().over(place))
    sums = [F.sum(F.when(F.col("_place") <= n, col(value))).alias(f"_top{n}") for n in sizes]
    day = ranked.groupBy("trade_date").agg(F.sum(value).alias("total"), *sums)
    return day.select("trade_date", "total", *[ratio(f"_top{n}", "total").alias(f"top{n}_share") for n in sizes])


def ladder(stock: DataFrame) -> DataFrame:
    """Distribution of limit-up streaks by day with the share of yesterday's that went on: stock(symbol, trade_index, streak)."""
    day = stock.where("streak > 0").groupBy("trade_index").agg(F.count_if(F.col("streak") == 1).alias("first"), F.count_if(F.col("streak") == 2).alias("second"), F.count_if(F.col("streak") == 3).alias("third"), F.count_if(F.col("streak") >= 4).alias("fourth_up"), F.max("streak").alias("height"), F.count("*").alias("held"), F.count_if(F.col("streak") > 1).alias("promoted"))
    before = day.select((F.col("trade_index") + 1).alias("trade_index"), F.col("held").alias("_before"))
    return day.join(before, "trade_index", "left").withColumn("promotion_rate", ratio("promoted", "_before")).drop("_before")


def coverage(rows: DataFrame, slices: dict[str, Column], matched: Column, key: str = "symbol") -> DataFrame:
    """Two levels in one pass: each key's matched share by slice, then full, partial and missing keys by slice."""
    parts = F.array(*[F.struct(F.lit(n).alias("slice"), F.coalesce(c.cast("string"), F.lit("NONE")).alias("value")) for n, c in slices.items()])
    long = rows.select(key, matched.alias("_ok"), F.explode(parts).alias("s")).select(key, "_ok", "s.*")
    one = long.groupBy("slice", "value", key).agg(F.count("*").alias("n"), F.count_if("_ok").alias("ok"))
    return one.groupBy("slice", "value").agg(F.count("*").alias("keys"), F.count_if(F.col("ok") == F.col("n")).alias("full"), F.count_if((F.col("ok") > 0) & (F.col("ok") < F.col("n"))).alias("partial"), F.count_if(F.col("ok") == 0).alias("missing"), F.sum("n").alias("rows"), F.sum("ok").alias("matched"))


def regime(day: DataFrame, n: int = 20, prior: int = 60, trend: float = 0.05) -> DataFrame:
    """day(trade_date, mean_return) with its regime: volatility above the 75th percentile of the prior window, else trend, else sideways."""
    w, before = days().rowsBetween(-(n - 1), 0), days().rowsBetween(-prior, -1)
    out = day.withColumns({"log_sum": F.when(F.count("mean_return").over(w) == n, F.sum(F.ln(F.greatest(1 + F.col("mean_return"), F.lit(1e-8)))).over(w)), "vol": F.when(F.count("mean_return").over(w) == n, F.stddev_samp("mean_return").over(w))})
    out = out.withColumn("vol_q75", F.percentile("vol", F.lit(0.75)).over(before))
    named = F.when(F.col("vol").isNull(), "UNKNOWN").when(F.col("vol") > F.col("vol_q75"), "HIGH_VOLATILITY").when(F.col("log_sum") > trend, "TREND_UP").when(F.col("log_sum") < -trend, "TREND_DOWN").otherwise("SIDEWAY")
    return out.withColumn("regime", named)


def return_stats(value: str = "ret") -> list[Column]:
    """Aggregates of a return: n, mean, median, win rate, profit factor, profit/loss ratio."""
    gain, loss = F.sum(F.when(F.col(value) > 0, F.col(value))), F.sum(F.when(F.col(value) < 0, -F.col(value)))
    mean_gain, mean_loss = F.avg(F.when(F.col(value) > 0, F.col(value))), F.avg(F.when(F.col(value) < 0, -F.col(value)))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), ratio(F.count_if(F.col(value) > 0), F.count(value)).alias("win_rate"), ratio(gain, loss).alias("profit_factor"), ratio(mean_gain, mean_loss).alias("profit_loss_ratio")]
