"""What a signal would have earned: trades under market rules before and after, and portfolios of cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import ratio
from asoflab.operators.evaluate import capped_weights


@dataclass(frozen=True)
class Rules:
    """Costs and limits of a market; sells on the day of the purchase are never allowed."""

    buy_commission: float = 0.0003
    sell_commission: float = 0.0003
    stamp_duty: float = 0.0005
    slippage: float = 0.0005
    tolerance: float = 0.001


@dataclass(frozen=True)
class Scenario:
    """When a signal buys, how much, and where it stops."""

    buy_score: float = 60.0
    strong_score: float = 80.0
    buy_exposure: float = 0.1
    strong_exposure: float = 0.2
    zone_width: float = 0.75
    stop_atr: float = 2.0


def with_future(grid: DataFrame, reach: int) -> DataFrame:
    """grid(symbol, trade_index, trade_date, open, high, low, close), a row for each symbol and session, with ``future``:
    the next ``reach`` sessions, those without a bar too, each with the last close before it. One shuffle by symbol."""
    by = Window.partitionBy("symbol").orderBy("trade_index")
    known = grid.withColumn("previous_close", F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    bar = F.struct("trade_date", "open", "high", "low", "close", "previous_close")
    return known.withColumn("future", F.collect_list(bar).over(by.rowsBetween(1, reach)))


def _at_limit(price: Column, previous: Column, rate: Column, direction: int, tolerance: float) -> Column:
    limit = previous * (1 + direction * rate)
    reached = price >= limit * (1 - tolerance) if direction > 0 else price <= limit * (1 + tolerance)
    return F.coalesce((previous > 0) & reached, F.lit(False))


def _marked(rules: Rules) -> Column:
    """The future bars with their place and what forbids to sell on them, if anything."""

    def mark(b: Column, i: Column) -> Column:
        closed = b["open"].isNull() | b["high"].isNull() | b["low"].isNull() | b["close"].isNull()
        flat = F.greatest(b["open"], b["high"], b["low"], b["close"]) - F.least(b["open"], b["high"], b["low"], b["close"]) <= 1e-9
        down = _at_limit(b["close"], b["previous_close"], F.col("rate"), -1, rules.tolerance)
        barred = F.when(closed, "SUSPENDED_OR_MISSING_EXIT").when(flat, "ONE_PRICE_EXIT").when(down, "LIMIT_DOWN_EXIT")
        return F.struct(i.alias("i"), b["trade_date"].alias("on"), b["open"].alias("open"), b["low"].alias("low"), b["close"].alias("close"), closed.alias("closed"), flat.alias("flat"), barred.alias("barred"))

    return F.transform("future", mark)


def _exit() -> Column:
    """Fold over the marked bars behind the entry: due at the stop or at the horizon, sold on the first bar that allows it."""
    start = F.struct(F.lit(False).alias("due"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("date").alias("on"), F.lit(None).cast("string").alias("barred"))
    scheduled = F.greatest(F.col("horizon") - 1, F.lit(1))

    def step(s: Column, b: Column) -> Column:
        stopped = ~s["due"] & ~b["closed"] & (F.col("stop") > 0) & (b["low"] <= F.col("stop")) & (b["i"] <= scheduled)
        due = s["due"] | F.coalesce(stopped, F.lit(False)) | (b["i"] >= scheduled)
        sold = due & b["barred"].isNull()
        price = F.when(sold, F.when(stopped, F.least(b["open"], F.col("stop"))).otherwise(b["close"]))
        after = F.struct(due.alias("due"), price.alias("price"), F.when(sold, b["on"]).alias("on"), F.when(due & ~sold, b["barred"]).otherwise(s["barred"]).alias("barred"))
        return F.when((b["i"] == 0) | s["price"].isNotNull(), s).otherwise(after)

    return F.aggregate("bars", start, step)


def trades(signals: DataFrame, horizons: Sequence[int], scenario: Scenario = Scenario(), rules: Rules = Rules()) -> DataFrame:
    """Each signal that the scenario buys, for each horizon, without and with market rules.

    signals(symbol, trade_date, close, atr, score, rate, zone_low, zone_high, future, ...) as ``with_future`` tells. Added:
    horizon, entry, exposure, base_return (bought at the next open inside the zone, left at the horizon's close or at the
    stop), and for the same trade under the rules reason, exit_date, exit_price and net_return. Barred are entries without a
    bar, at one price or at the upper limit, and sales on the first day; exits wait for a bar that is neither missing,
    of one price nor at the lower limit. reason tells why there is no trade.
    """
    stop = F.col("close") - scenario.stop_atr * F.col("atr")
    high = F.col("zone_low") + scenario.zone_width * (F.col("zone_high") - F.col("zone_low"))
    df = signals.where(F.col("score") >= scenario.buy_score).withColumns({"bars": _marked(rules), "stop": stop, "first": F.get("future", F.lit(0))}).withColumn("entry", F.col("first.open"))
    df = df.where((F.col("entry") > 0) & F.col("entry").between(F.col("zone_low"), high))
    df = df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).where(F.size("future") >= F.col("horizon"))
    until = F.slice("bars", F.lit(1), F.col("horizon"))
    last = F.get("bars", F.col("horizon") - 1)["close"]
    hit = F.get(F.filter(until, lambda b: (F.col("stop") > 0) & b["open"].isNotNull() & (b["low"] <= F.col("stop"))), F.lit(0))
    base = F.when(hit.isNotNull(), F.least(hit["open"], F.col("stop"))).otherwise(last)
    df = df.where(last.isNotNull()).withColumn("base_return", base / F.col("entry") - 1)
    first = F.get("bars", F.lit(0))
    barred = F.when(first["closed"], "SUSPENDED_OR_MISSING_ENTRY").when(first["flat"], "ONE_PRICE_ENTRY").when(_at_limit(F.col("entry"), F.col("first.previous_close"), F.col("rate"), 1, rules.tolerance), "LIMIT_UP_ENTRY")
    df = df.withColumn("barred", barred).withColumn("left", F.when(F.col("barred").isNull(), _exit()))
    bought = F.col("entry") * (1 + rules.slippage) * (1 + rules.buy_commission)
    sold = F.col("left.price") * (1 - rules.slippage) * (1 - rules.sell_commission - rules.stamp_duty)
    reason = F.coalesce("barred", F.when(F.col("left.price").isNull(), F.coalesce("left.barred", F.lit("NO_EXECUTABLE_EXIT"))))
    exposure = F.when(F.col("score") >= scenario.strong_score, scenario.strong_exposure).otherwise(scenario.buy_exposure)
    told = {"exposure": exposure, "reason": reason, "entry_date": F.col("first.trade_date"), "exit_date": F.col("left.on"), "exit_price": F.col("left.price"), "net_return": sold / bought - 1}
    return df.withColumns(told).drop("bars", "first", "future", "barred", "left")


def with_benchmark(told: DataFrame, index: DataFrame) -> DataFrame:
    """trades with the index's return from the entry's open to the close at the horizon (base_benchmark) and at the real exit
    (net_benchmark). index(trade_date, trade_index, open, close): one row for each session, so it is broadcast."""
    a = index.select(F.col("trade_date").alias("entry_date"), F.col("trade_index").alias("_from"), F.col("open").alias("_open"))
    z = index.select(F.col("trade_date").alias("exit_date"), F.col("close").alias("_net"))
    h = index.select((F.col("trade_index")).alias("_to"), F.col("close").alias("_base"))
    out = told.join(F.broadcast(a), "entry_date", "left").withColumn("_to", F.col("_from") + F.col("horizon") - 1)
    out = out.join(F.broadcast(z), "exit_date", "left").join(F.broadcast(h), "_to", "left")
    return out.withColumns({"base_benchmark": ratio("_base", "_open") - 1, "net_benchmark": ratio("_net", "_open") - 1}).drop("_from", "_to", "_open", "_net", "_base")


def _cohort_drawdown(rows: DataFrame, keys: Sequence[str], ret: str, span: Column) -> DataFrame:
    """(keys, drawdown) of portfolios of every ``span``-th signal date, exposures scaled to 1 at most. Windows hold a row for each date."""
    total = F.sum("exposure")
    day = rows.groupBy(*keys, "trade_date").agg((F.sum(F.col(ret) * F.col("exposure")) * F.when(total <= 1, F.lit(1.0)).otherwise(1 / total)).alias("r"))
    by = Window.partitionBy(*keys).orderBy("trade_date")
    day = day.withColumn("_k", F.row_number().over(by) - 1).where(F.col("_k") % span == 0)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    nav = day.withColumn("nav", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-8)))).over(upto)))
    return nav.withColumn("d", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(upto)) - 1).groupBy(*keys).agg(F.min("d").alias("drawdown"))


def _side(rows: DataFrame, keys: Sequence[str], ret: str, benchmark: str, span: Column, mark: str) -> DataFrame:
    x = F.col(ret)
    gain, loss = F.avg(F.when(x > 0, x)), F.avg(F.when(x < 0, x))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("average"), F.percentile(x, F.lit(0.5)).alias("median"),
        ratio(gain, F.abs(loss)).alias("profit_loss"), F.avg(x - F.col(benchmark)).alias("excess"),
    )
    out = out.join(_cohort_drawdown(rows, keys, ret, span), list(keys), "left")
    return out.select(*keys, *[F.col(c).alias(f"{c}_{mark}") for c in out.columns if c not in keys])


def rule_comparison(told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By keys (horizon among them): the trades without the rules and with them, entries and exits that the rules bar, and the differences."""
    done = told.where("net_return IS NOT NULL")
    before = _side(told, keys, "base_return", "base_benchmark", F.col("horizon"), "before")
    after = _side(done, keys, "net_return", "net_benchmark", F.greatest(F.col("horizon"), F.lit(2)), "after")
    barred = told.groupBy(*keys).agg(F.count_if(F.col("reason").contains("ENTRY")).alias("barred_entries"), F.count_if(F.col("reason").isNotNull() & ~F.col("reason").contains("ENTRY")).alias("barred_exits"))
    out = before.join(barred, list(keys)).join(after, list(keys), "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    return out.withColumns({"average_difference": F.col("average_after") - F.col("average_before"), "n_difference": F.col("n_after") - F.col("n_before")})


def cohorts(observations: DataFrame, keys: Sequence[str], horizon: int, rule: str = "EVERY_HORIZON") -> DataFrame:
    """(keys, trade_date, cohort): signal dates whose cohorts don't overlap, numbered from 1.

    EVERY_HORIZON takes every ``horizon``-th signal date; AFTER_EXIT the first date after the last cohort's last exit, a fold
    over one array of a row for each date; FIRST the first date; ALL every date.
    """
    days = observations.groupBy(*keys, "trade_date").agg(F.max("exit_date").alias("exit_date"))
    place = Window.partitionBy(*keys).orderBy("trade_date")
    if rule == "AFTER_EXIT":
        own = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trade_date", "exit_date"))).alias("days"))
        start = F.struct(F.lit(None).cast("date").alias("until"), F.array().cast("array<date>").alias("taken"))
        free = lambda s, d: s["until"].isNull() | (d["trade_date"] > s["until"])
        step = lambda s, d: F.when(free(s, d), F.struct(F.coalesce(d["exit_date"], d["trade_date"]).alias("until"), F.concat(s["taken"], F.array(d["trade_date"])).alias("taken"))).otherwise(s)
        days = own.select(*keys, F.explode(F.aggregate("days", start, step)["taken"]).alias("trade_date"))
    else:
        every = {"EVERY_HORIZON": horizon, "ALL": 1}.get(rule)
        days = days.withColumn("_k", F.row_number().over(place) - 1).where(F.col("_k") % every == 0 if every else F.col("_k") == 0)
    return days.select(*keys, "trade_date", F.row_number().over(place).alias("cohort"))


def cohort_positions(observations: DataFrame, keys: Sequence[str], horizon: int, top: int, cap: float, equal: bool = False, rule: str = "EVERY_HORIZON") -> DataFrame:
    """(keys, cohort, trade_date, symbol, weight, ret, benchmark, exit_date) of observations(keys, trade_date, symbol, rank, score, ret,
    benchmark, exit_date): the best ``top`` of each cohort by rank, weighted by score (or equally) with none above cap."""
    chosen = observations.join(cohorts(observations, keys, horizon, rule), [*keys, "trade_date"])
    place = F.row_number().over(Window.partitionBy(*keys, "cohort").orderBy("rank", "symbol"))
    best = chosen.withColumn("_place", place).where(F.col("_place") <= top)
    held = best.groupBy(*keys, "cohort", "trade_date").agg(F.array_sort(F.collect_list(F.struct("_place", "symbol", "score", "ret", "benchmark", "exit_date"))).alias("held"))
    score = F.transform("held", lambda x: F.greatest(F.lit(0.0), F.coalesce(x["score"].cast("double"), F.lit(0.0))))
    one = F.transform("held", lambda x: F.lit(1.0))
    raw = one if equal else F.when(F.exists(score, lambda x: x > 0), score).otherwise(one)
    w = held.withColumn("w", capped_weights(raw, cap, rounds=top)).select(*keys, "cohort", "trade_date", F.explode(F.arrays_zip("held", "w")).alias("z"))
    return w.select(*keys, "cohort", "trade_date", "z.held.symbol", F.col("z.w").alias("weight"), "z.held.ret", "z.held.benchmark", "z.held.exit_date")


def cohort_series(positions: DataFrame, keys: Sequence[str], cost: float) -> DataFrame:
    """One row for each cohort of positions: return, benchmark, turnover against the cohort before (half the sum of weight changes;
    all of the weight at first), cost, value compounded so far and its drawdown. Windows hold a row for each cohort."""
    before = positions.select(*keys, (F.col("cohort") + 1).alias("cohort"), "symbol", F.col("weight").alias("_before"))
    moved = positions.join(before, [*keys, "cohort", "symbol"], "full").groupBy(*keys, "cohort").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))) / 2).alias("_moved"))
    rows = positions.groupBy(*keys, "cohort", "trade_date").agg(F.count("*").alias("members"), F.sum("weight").alias("invested"), F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.avg("benchmark").alias("benchmark"), F.max("exit_date").alias("exit_date"))
    rows = rows.join(moved, [*keys, "cohort"])  # inner: drops what the last cohort would be turned into
    upto = Window.partitionBy(*keys).orderBy("cohort").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turnover", F.when(F.col("cohort") == 1, F.col("invested")).otherwise(F.col("_moved"))).drop("_moved")
    grown = lambda c: F.exp(F.sum(F.ln(F.greatest(1 + F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-8)))).over(upto))
    rows = rows.withColumns({"cost": F.col("turnover") * cost, "value": grown("ret"), "benchmark_value": grown("benchmark")})
    return rows.withColumn("drawdown", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(upto)) - 1)


def cohort_metrics(series: DataFrame, keys: Sequence[str], year: int = 252, least: int = 60) -> DataFrame:
    """One row for each portfolio: gross, net, benchmark and excess return, drawdown, turnover, deviations, and the annual
    figures, Sharpe, Sortino and information ratio that need ``least`` cohorts."""
    root = F.sqrt(F.lit(float(year)))
    out = series.groupBy(*keys).agg(
        F.count("*").alias("cohorts"), F.sum("members").alias("positions"), (F.max_by("value", "cohort") - 1).alias("gross"), F.sum("cost").alias("costs"),
        F.when(F.count("benchmark") > 0, F.max_by("benchmark_value", "cohort") - 1).alias("benchmark_return"), F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover"),
        F.avg("ret").alias("_mean"), F.when(F.count("*") >= 2, F.stddev_pop("ret")).alias("_sd"), F.sqrt(F.avg(F.pow(F.least(F.lit(0.0), F.col("ret")), F.lit(2.0)))).alias("downside"),
        F.avg(F.col("ret") - F.col("benchmark")).alias("_ahead"), F.when(F.count("benchmark") >= 2, F.stddev_pop(F.col("ret") - F.col("benchmark"))).alias("tracking_error"),
    )
    full = F.col("cohorts") >= least
    return out.withColumns({
        "net": F.col("gross") - F.col("costs"), "excess": F.col("gross") - F.col("benchmark_return"), "annual_return": F.when(full, F.pow(1 + F.col("gross"), F.lit(float(year)) / F.col("cohorts")) - 1),
        "annual_volatility": F.when(full, F.col("_sd") * root), "sharpe": F.when(full, ratio("_mean", "_sd") * root), "sortino": F.when(full, ratio("_mean", "downside") * root), "information_ratio": F.when(full, ratio("_ahead", "tracking_error") * root),
    }).drop("_mean", "_sd", "_ahead")
