"""Composite scores and their evaluation, factor weights, overlap of evidence, allocations, and metrics of a daily series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import average_rank, clip, col, pearson, ratio, scaled_rank, zscore
from asoflab.sources import shared


def _mean_of(columns: Sequence[Column], count: Column) -> Column:
    return ratio(sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)), count)


def _there(columns: Sequence[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def composite_packets(df: DataFrame, features: Sequence[tuple[str, int, str]], reminder: Column, least: int = 2) -> DataFrame:
    """df with composite scores over features (column, direction, family), each within its day.

    equal_weight and rank_average are means of signed z-scores and ranks over the features that are there, NULL below
    ``least``; family_average is the mean of the families' mean ranks, NULL unless each family has one; confidence is the
    share of features that are there; risk_reminder is ``reminder``, which may use the ranks ({column}_rank).
    """
    z = {f"{c}_z": zscore(c, "trade_date", sign=s) for c, s, _ in features}
    ranks = {f"{c}_rank": scaled_rank(c, "trade_date", signed=True) * s for c, s, _ in features}
    out = df.withColumns(z | ranks)
    own = [F.col(c) for c in z]
    observed = _there(own)
    families = {}
    for c, _, family in features:
        families.setdefault(family, []).append(F.col(f"{c}_rank"))
    means = [_mean_of(r, _there(r)) for r in families.values()]
    every = means[0]
    for m in means[1:]:
        every = every + m
    return out.withColumns({
        "observed": observed, "equal_weight": F.when(observed >= least, _mean_of(own, observed)), "rank_average": F.when(observed >= least, _mean_of([F.col(c) for c in ranks], observed)),
        "family_average": every / len(means), "confidence": observed / float(len(features)), "risk_reminder": F.coalesce(reminder, F.lit(False)),
    }).drop(*z)


def _correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    if a.min() == a.max() or b.min() == b.max():
        return None
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).mean()) * np.sqrt((b * b).mean())
    return float((a * b).mean() / scale) if scale > 0 else None


def _places(x: np.ndarray) -> np.ndarray:
    """Ranks, of equal values the smallest."""
    return np.searchsorted(np.sort(x), x).astype(float)


def _method_day(methods: Sequence[str], least: int, columns: Sequence[str]):
    """The figures of a day, from its packets and its labels."""

    def run(packets: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = labels.drop(columns="trade_date").merge(packets, on="symbol").sort_values("symbol", kind="stable")
        for (label_type, horizon), g in rows.groupby(["label_type", "horizon"], dropna=False):
            for method in methods:
                x, y = g[method].to_numpy(float), g["y"].to_numpy(float)
                seen = ~np.isnan(x)
                x, y, n = x[seen], y[seen], int(seen.sum())
                if n < max(least, 1):
                    continue
                by_x = y[np.argsort(x, kind="stable")]  # ties by symbol
                fifth = n // 5
                q5, q1 = by_x[n - fifth :].mean() if fifth else None, by_x[: fifth + (n % 5 > 0)].mean()
                out.append((method, label_type, horizon, g["trade_date"].iat[0], n, _correlation(x, y), _correlation(_places(x), _places(y)), q5, q1))
        return pd.DataFrame(out, columns=list(columns))

    return run


def method_days(packets: DataFrame, labels: DataFrame, methods: Sequence[str], least: int = 20) -> DataFrame:
    """(method, label_type, horizon, trade_date, n, ic, rank_ic, q5, q1) of packets(symbol, trade_date, methods...) against the
    complete labels(symbol, trade_date, label_type, horizon, ret, status); days with fewer rows are left out.

    A day's packets and labels meet in one task, once for all methods; no row moves for each method and label."""
    shared.importable(packets.sparkSession)
    left = packets.where("symbol IS NOT NULL").select("symbol", "trade_date", *[F.col(m).cast("double").alias(m) for m in methods])
    right = labels.where("status = 'COMPLETE' AND ret IS NOT NULL AND symbol IS NOT NULL").select("symbol", "trade_date", "label_type", "horizon", F.col("ret").cast("double").alias("y"))
    kinds = dict(right.dtypes)
    schema = f"method string, label_type {kinds['label_type']}, horizon {kinds['horizon']}, trade_date {kinds['trade_date']}, n long, ic double, rank_ic double, q5 double, q1 double"
    day = _method_day(methods, least, ["method", "label_type", "horizon", "trade_date", "n", "ic", "rank_ic", "q5", "q1"])
    return left.groupBy("trade_date").cogroup(right.groupBy("trade_date")).applyInPandas(day, schema)


def composite_evaluation(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over days by method, label type and horizon (and ``by``): samples, valid dates, IC, rank IC, spread of the outer fifths."""
    return days.groupBy(*by, "method", "label_type", "horizon").agg(
        F.sum("n").alias("samples"), F.count("*").alias("valid_dates"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.avg(F.col("q5") - F.col("q1")).alias("spread"), F.avg("q5").alias("q5"), F.avg("q1").alias("q1")
    )


def with_grain(days: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """Each day once for each grain it belongs to: FULL, its YEAR, MONTH and QUARTER, and REGIME where regimes(trade_date, regime) has it."""
    d = F.col("trade_date")
    grain = lambda kind, period: F.struct(F.lit(kind).alias("grain"), period.alias("period"))
    year = F.year(d).cast("string")
    grains = [grain("FULL", F.lit("ALL")), grain("YEAR", year), grain("QUARTER", F.concat(year, F.lit("-Q"), F.quarter(d).cast("string"))), grain("MONTH", F.date_format(d, "yyyy-MM"))]
    if regimes is not None:
        days = days.join(regimes.select("trade_date", "regime"), "trade_date", "left")
        grains.append(grain("REGIME", F.coalesce("regime", F.lit("UNKNOWN"))))
    return days.withColumn("_g", F.explode(F.array(*grains))).withColumns({"grain": F.col("_g.grain"), "period": F.col("_g.period")}).drop("_g")


def reminder_returns(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """By horizon: how many packets carry the reminder, and the mean complete return with it, without it, and their difference."""
    j = packets.select("symbol", "trade_date", "risk_reminder").join(labels.select("symbol", "trade_date", "horizon", F.when(F.col("status") == "COMPLETE", F.col("ret")).alias("y")), ["symbol", "trade_date"])
    a, b = F.avg(F.when(F.col("risk_reminder"), F.col("y"))), F.avg(F.when(~F.col("risk_reminder"), F.col("y")))
    out = j.groupBy("horizon").agg(F.count_if("risk_reminder").alias("reminders"), F.count_if(F.col("risk_reminder") & F.col("y").isNotNull()).alias("labelled"), a.alias("with_reminder"), b.alias("without"))
    return out.withColumn("difference", F.col("with_reminder") - F.col("without"))


def group_spread(df: DataFrame, keys: Sequence[str], score: str = "score", ret: str = "ret", least: int = 20) -> DataFrame:
    """Mean return of the best fifth less that of the worst, by keys and day; fifths by cumulative share."""
    by = [*keys, "trade_date"]
    pairs = df.where(col(score).isNotNull() & col(ret).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least)
    q = F.least(F.lit(5), F.ceil(F.cume_dist().over(Window.partitionBy(*by).orderBy(col(score))) * 5))
    day = pairs.withColumn("_q", q).groupBy(*by).agg(F.avg(F.when(F.col("_q") == 5, col(ret))).alias("top"), F.avg(F.when(F.col("_q") == 1, col(ret))).alias("bottom"))
    return day.withColumn("spread", F.col("top") - F.col("bottom"))


def group_curve(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """members(keys, trade_date, trade_index, symbol, ret) as daily mean, median, winners' share, turnover against the
    group's day before (1 - retained / members), cumulative return, and drawdown from its highest value so far (1 at first)."""
    by = [*keys, "trade_date", "trade_index"]
    before = members.select(*keys, "symbol", (F.col("trade_index") + 1).alias("trade_index"), F.lit(1).alias("_held"))
    m = members.join(before, [*keys, "symbol", "trade_index"], "left")
    day = m.groupBy(*by).agg(F.count("*").alias("members"), F.count("_held").alias("retained"), F.avg("ret").alias("mean"), F.percentile("ret", F.lit(0.5)).alias("median"), F.avg((F.col("ret") > 0).cast("double")).alias("win"))
    upto = Window.partitionBy(*keys).orderBy("trade_index").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("turnover", 1 - F.col("retained") / F.col("members")).withColumn("curve", F.exp(F.sum(F.ln(F.greatest(1 + F.coalesce("mean", F.lit(0.0)), F.lit(1e-8)))).over(upto)))
    return day.withColumn("drawdown", F.col("curve") / F.greatest(F.lit(1.0), F.max("curve").over(upto)) - 1)


def evidence_overlap(ids: DataFrame, rules: Sequence[tuple[str, str, str, float, str]]) -> DataFrame:
    """(symbol, a, b, shared, overlap, discount, discounted) from ids(symbol, factor, basis, id) for rules (a, b, basis, most,
    discounted factor): Jaccard overlap of CLUSTER ids, overlap of the smaller set for other ids, times ``most``.

    An id of a symbol holds few factors, so its pairs are made from their set; no two rows of ids meet in a join.
    """
    distinct = ids.select("symbol", "factor", "basis", "id").where("id IS NOT NULL").distinct()
    sizes = distinct.groupBy("symbol", "basis", "factor").agg(F.count("*").alias("n"))
    held = distinct.groupBy("symbol", "basis", "id").agg(F.collect_set("factor").alias("factors"))
    pair = F.explode(F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind"), F.lit(float(m)).alias("most"), F.lit(d).alias("discounted")) for a, b, k, m, d in rules]), lambda r: (r["kind"] == F.col("basis")) & F.array_contains("factors", r["a"]) & F.array_contains("factors", r["b"])))
    shared = held.select("symbol", "basis", pair.alias("r")).select("symbol", "basis", "r.a", "r.b", "r.most", "r.discounted").groupBy("symbol", "basis", "a", "b", "most", "discounted").agg(F.count("*").alias("shared"))
    left = sizes.select("symbol", "basis", F.col("factor").alias("a"), F.col("n").alias("n_a"))
    right = sizes.select("symbol", "basis", F.col("factor").alias("b"), F.col("n").alias("n_b"))
    told = shared.join(left, ["symbol", "basis", "a"]).join(right, ["symbol", "basis", "b"])
    overlap = F.when(F.col("basis") == "CLUSTER", ratio("shared", F.col("n_a") + F.col("n_b") - F.col("shared"))).otherwise(ratio("shared", F.least("n_a", "n_b")))
    return told.withColumn("overlap", overlap).withColumn("discount", F.least(F.col("most"), F.col("most") * F.col("overlap"))).select("symbol", "a", "b", "basis", "shared", "overlap", "discount", "discounted")


def shadow_composite(factors: DataFrame, overlaps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row of each symbol from factors(symbol, factor, score, confidence, availability): score, confidence and, by factor,
    effective weight and contribution. A factor's weight is configured x confidence x availability x (1 - discount) for each
    of its discounts, renormalised; confidence is the weight before that, times coverage, times a third for each factor
    up to three, times (1 - discount / 2) for each discount."""
    base = F.coalesce(*[F.when(F.col("factor") == k, F.lit(float(v))) for k, v in weights.items()])
    cut = overlaps.groupBy("symbol", F.col("discounted").alias("factor")).agg(F.exp(F.sum(F.ln(1 - F.col("discount")))).alias("kept"))
    penalty = overlaps.groupBy("symbol").agg(F.exp(F.sum(F.ln(1 - F.col("discount") * 0.5))).alias("penalty"))
    w = factors.join(cut, ["symbol", "factor"], "left").withColumn("w", base * F.col("confidence") * F.col("availability") * F.coalesce("kept", F.lit(1.0))).where("availability > 0 AND w IS NOT NULL")
    w = w.withColumn("total", F.sum("w").over(Window.partitionBy("symbol"))).where("total > 0").withColumn("effective", F.col("w") / F.col("total"))
    told = F.sort_array(F.collect_list(F.struct("factor", F.round("effective", 6).alias("weight"), F.round(F.col("effective") * F.col("score"), 6).alias("contribution"))))
    out = w.groupBy("symbol").agg(F.sum(F.col("effective") * F.col("score")).alias("score"), F.count("*").alias("available"), F.first("total").alias("total"), told.alias("parts"))
    out = out.join(penalty, "symbol", "left")
    confidence = F.col("total") * F.col("available") / float(len(weights)) * F.least(F.lit(1.0), F.col("available") / 3) * F.coalesce("penalty", F.lit(1.0))
    return out.select("symbol", clip("score").alias("score"), clip(confidence, 0.0).alias("confidence"), "available", "parts")


def nav_metrics(daily: DataFrame, rf: float = 0.02, year: int = 252) -> DataFrame:
    """One row from daily(trade_date, ret): total and annual return, volatility, Sharpe, Sortino, deepest drawdown, Calmar,
    winners' share by month, 95% value at risk and mean of the worst twentieth. One row for each day goes in order."""
    by = Window.orderBy("trade_date")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select("trade_date", F.coalesce("ret", F.lit(0.0)).alias("ret")).withColumn("nav", F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-8)))).over(upto)))
    d = d.withColumn("drawdown", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(upto)) - 1)
    month = d.groupBy(F.date_format("trade_date", "yyyy-MM").alias("m")).agg(F.max_by("nav", "trade_date").alias("nav"))
    month = month.withColumn("move", F.col("nav") / F.lag("nav").over(Window.orderBy("m")) - 1).agg(F.avg(F.when(F.col("move").isNotNull(), (F.col("move") > 0).cast("double"))).alias("w")).first()["w"]  # one number
    low = d.agg(F.percentile("ret", F.lit(0.05)).alias("q")).first()["q"]  # one number
    t = d.agg(F.count("*").alias("days"), (F.max_by("nav", "trade_date") - 1).alias("total"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(year)))).alias("volatility"), (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(F.lit(float(year)))).alias("downside"), F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("ret") <= low, F.col("ret"))).alias("tail_mean"))
    annual = F.pow(1 + F.col("total"), F.lit(float(year)) / F.col("days")) - 1
    t = t.withColumn("annual", annual).withColumns({"sharpe": ratio(F.col("annual") - rf, "volatility"), "sortino": ratio(F.col("annual") - rf, "downside"), "calmar": ratio("annual", F.abs("max_drawdown")), "var_95": F.lit(low), "monthly_win": F.lit(month)})
    return t


def rolling_risk(daily: DataFrame, n: int = 63, m: int = 252, rf: float = 0.02, year: int = 252) -> DataFrame:
    """(trade_date, volatility, sharpe, drawdown) of daily(trade_date, ret) over the last n and m days; NULL until they are full, sharpe 0 then."""
    by = Window.orderBy("trade_date")
    short, long, upto = by.rowsBetween(-(n - 1), 0), by.rowsBetween(-(m - 1), 0), by.rowsBetween(Window.unboundedPreceding, 0)
    log = F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-8)))
    d = daily.select("trade_date", F.coalesce("ret", F.lit(0.0)).alias("ret")).withColumn("nav", F.exp(F.sum(log).over(upto)))
    d = d.withColumn("volatility", F.when(F.count("ret").over(short) >= n, F.stddev_samp("ret").over(short) * F.sqrt(F.lit(float(year)))))
    annual = F.when(F.count("ret").over(long) >= m, F.exp(F.sum(log).over(long) * (year / m)) - 1)
    return d.select("trade_date", "volatility", F.coalesce(ratio(annual - rf, "volatility"), F.lit(0.0)).alias("sharpe"), (F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(upto)) - 1).alias("drawdown"))


def worst_days(daily: DataFrame, n: int = 5) -> DataFrame:
    return daily.select("trade_date", "ret").where("ret IS NOT NULL").orderBy("ret", "trade_date").limit(n)


def rebalance_days(days: DataFrame) -> DataFrame:
    """The first trading day of each month of days(trade_date)."""
    return days.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min("trade_date").alias("trade_date"))


def allocations(prices: DataFrame, rebalances: DataFrame, groups: Sequence[str] = (), lookback: int = 20, top: int = 2, window: int = 20, cap: float = 0.6, trend: int = 30, fixed: Column | None = None, defensive: Column | None = None, rounds: int = 8) -> DataFrame:
    """(groups, trade_date, symbol, method, weight) at each rebalance date from the rows before it: FIXED (weights ``fixed``),
    EQUAL, CROSS_MOMENTUM (the best ``top`` with a positive momentum), DUAL_MOMENTUM (the best risky asset if it rose, else the
    defensive one), INVERSE_VOLATILITY (capped; what is cut goes to the others in proportion) and TREND_DEFENSE (assets below
    their mean give their fixed weight to the defensive one). What is not given is cash.

    prices(groups, symbol, trade_date, close), one row for each asset and day it trades; ``defensive`` marks one asset of a group.
    """
    by = Window.partitionBy(*groups, "symbol").orderBy("trade_date")
    before = lambda n: by.rowsBetween(-n, -1)
    p = prices.withColumn("move", ratio("close", F.lag("close").over(by)) - 1)
    p = p.withColumns({
        "momentum": ratio(F.lag("close", 1).over(by), F.lag("close", lookback + 1).over(by)) - 1, "last": F.lag("close", 1).over(by),
        "sd": F.when(F.count("move").over(before(window)) >= window, F.stddev_samp("move").over(before(window))), "mean": F.when(F.count("close").over(before(trend)) >= trend, F.avg("close").over(before(trend))),
        "defensive": F.coalesce(defensive if defensive is not None else F.lit(False), F.lit(False)), "fixed": F.coalesce(fixed if fixed is not None else F.lit(None).cast("double"), F.lit(0.0)),
    }).join(rebalances.select("trade_date"), "trade_date", "left_semi")
    day = Window.partitionBy(*groups, "trade_date")
    total = F.sum("fixed").over(day)
    p = p.withColumn("fixed", F.coalesce(ratio("fixed", total), F.lit(0.0)))
    place = F.row_number().over(day.orderBy(F.when(F.col("momentum") > 0, F.col("momentum")).desc_nulls_last(), "symbol"))
    risky = F.row_number().over(day.orderBy(F.when(~F.col("defensive"), F.col("momentum")).desc_nulls_last(), "symbol"))
    p = p.withColumns({"place": place, "risky": risky, "n": F.count("*").over(day), "up": F.least(F.lit(top), F.count_if(F.col("momentum") > 0).over(day))})
    dual = (F.col("risky") == 1) & ~F.col("defensive") & (F.col("momentum") > 0)
    p = p.withColumn("dual", dual).withColumn("any_dual", F.max("dual").over(day))
    broken = ~F.col("defensive") & F.coalesce(F.col("last") < F.col("mean"), F.lit(False))
    p = p.withColumn("broken", broken).withColumn("moved", F.sum(F.when(F.col("broken"), F.col("fixed")).otherwise(0.0)).over(day))
    inverse = F.coalesce(ratio(F.lit(1.0), "sd"), F.lit(0.0))
    p = p.withColumn("inverse", inverse).withColumn("inverse", F.when(F.sum("inverse").over(day) > 0, F.col("inverse")).otherwise(1.0))
    p = p.withColumn("iv", F.col("inverse") / F.sum("inverse").over(day))
    for _ in range(rounds):
        over, free = F.sum(F.greatest(F.col("iv") - cap, F.lit(0.0))).over(day), F.sum(F.when(F.col("iv") < cap, F.col("iv")).otherwise(0.0)).over(day)
        p = p.withColumn("iv", F.when(F.col("iv") >= cap, F.lit(cap)).otherwise(F.col("iv") + F.coalesce(ratio(F.col("iv") * over, free), F.lit(0.0))))
    methods = {
        "FIXED": F.col("fixed"), "EQUAL": F.lit(1.0) / F.col("n"), "CROSS_MOMENTUM": F.when((F.col("place") <= F.col("up")) & (F.col("momentum") > 0), F.lit(1.0) / F.col("up")).otherwise(0.0),
        "DUAL_MOMENTUM": F.when(F.col("dual"), 1.0).when(F.col("defensive") & ~F.col("any_dual"), 1.0).otherwise(0.0), "INVERSE_VOLATILITY": F.col("iv"),
        "TREND_DEFENSE": F.when(F.col("broken"), 0.0).otherwise(F.col("fixed")) + F.when(F.col("defensive"), F.col("moved")).otherwise(0.0),
    }
    wide = p.select(*groups, "trade_date", "symbol", *[w.alias(k) for k, w in methods.items()])
    return wide.unpivot([*groups, "trade_date", "symbol"], list(methods), "method", "weight").where("weight > 0")


def ic_weights(daily: DataFrame, factors: Sequence[str], bounds: dict[str, tuple[float, float]], window: int = 60, drift: float = 0.05, inverse: bool = False) -> DataFrame:
    """(trade_date, factors...) weights of each day from daily(trade_date, factors...), one row for each day: the trailing mean IC
    (0.001 at least) or, with ``inverse``, one over the trailing sd; normalised, held within bounds, what that leaves given to
    those with room in proportion to it, and no farther than ``drift`` from the day before.

    The drift is a fold over the days, in one array of one row for each day.
    """
    by = Window.orderBy("trade_date")
    past = by.rowsBetween(-(window - 1), 0)
    raw = {f: F.coalesce(ratio(F.lit(1.0), F.when(F.stddev_samp(f).over(past) > 1e-6, F.stddev_samp(f).over(past))), F.lit(10.0)) if inverse else F.greatest(F.lit(0.001), F.coalesce(F.avg(f).over(past), F.lit(0.001))) for f in factors}
    d = daily.select("trade_date", *[v.alias(f) for f, v in raw.items()])
    total = sum((F.col(f) for f in factors), F.lit(0.0))
    d = d.select("trade_date", *[(F.col(f) / total).alias(f) for f in factors])
    d = d.select("trade_date", *[clip(f, *bounds[f]).alias(f) for f in factors])
    gap = 1 - sum((F.col(f) for f in factors), F.lit(0.0))
    d = d.withColumn("gap", gap)
    room = {f: F.when(F.col("gap") > 0, F.lit(bounds[f][1]) - F.col(f)).when(F.col("gap") < 0, F.col(f) - F.lit(bounds[f][0])).otherwise(0.0) for f in factors}
    d = d.withColumns({f"room_{f}": v for f, v in room.items()})
    rooms = sum((F.col(f"room_{f}") for f in factors), F.lit(0.0))
    d = d.select("trade_date", F.array(*[F.col(f) + F.coalesce(ratio(F.col("gap") * F.col(f"room_{f}"), rooms), F.col("gap") / len(factors)) for f in factors]).alias("w"))

    def limited(before: Column, target: Column) -> Column:
        near = F.zip_with(before, target, lambda b, t: F.greatest(b - drift, F.least(b + drift, t)))
        return F.transform(near, lambda x: x / F.aggregate(near, F.lit(0.0), lambda s, y: s + y))

    days = d.agg(F.array_sort(F.collect_list(F.struct("trade_date", "w"))).alias("days"))
    start = F.array(F.get("days", F.lit(0)))
    step = lambda done, day: F.concat(done, F.array(F.struct(day["trade_date"].alias("trade_date"), limited(F.element_at(done, -1)["w"], day["w"]).alias("w"))))
    out = days.select(F.explode(F.aggregate(F.slice("days", 2, F.greatest(F.size("days") - 1, F.lit(0))), start, step)).alias("d"))
    return out.where("d IS NOT NULL").select("d.trade_date", *[F.col("d.w")[k].alias(f) for k, f in enumerate(factors)])


def rank_correlation(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Spearman correlation of two columns by keys."""
    both = df.where(col(a).isNotNull() & col(b).isNotNull())
    ranked = both.withColumns({"_a": average_rank(a, *keys), "_b": average_rank(b, *keys)})
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("_a", "_b").alias("rho"))
