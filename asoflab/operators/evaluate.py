"""Labels, factor evaluation, multiple testing and strategy research."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import average_rank, col, normal_p_value, pearson, ratio


def price_grid(bars: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Symbols x calendar with closes, opens and, for each horizon, forward extremes and observed bars: one shuffle for all."""
    # few bytes that become many rows: as many tasks as keep every core busy, which sizes alone would not give
    symbols = bars.select("symbol").distinct().repartition(4 * bars.sparkSession.sparkContext.defaultParallelism, "symbol")
    grid = symbols.crossJoin(F.broadcast(calendar)).join(bars, ["symbol", "trade_date"], "left")
    by = Window.partitionBy("symbol").orderBy("trade_index")
    out = {}
    for h in horizons:
        w = by.rowsBetween(1, h)
        out |= {f"low_{h}": F.min("low").over(w), f"high_{h}": F.max("high").over(w), f"seen_{h}": F.count("close").over(w)}
    return grid.withColumns(out)


def forward_labels(grid: DataFrame, horizons: Sequence[int], executable: bool = False) -> DataFrame:
    """Long labels (symbol, trade_date, horizon, entry_date, exit_date, ret, mae, mfe, status) of the grid's observed rows.

    Statistical labels run close to close; executable ones enter at the next open and
    leave at close max(h, 2) sessions on. Status: the first that holds of
    INSUFFICIENT_FORWARD_WINDOW, MISSING_ENTRY, MISSING_EXIT, PARTIAL (fewer bars than sessions), COMPLETE.
    """
    by = Window.partitionBy("symbol").orderBy("trade_index")
    last = F.max("trade_index").over(Window.partitionBy("symbol"))
    parts, needed = [], {}
    for h in horizons:
        out = max(h, 2) if executable else h
        needed |= {f"exit_{h}": F.lead("close", out).over(by), f"exit_date_{h}": F.lead("trade_date", out).over(by)}
    df = grid.withColumns(needed | {"entry": F.lead("open", 1).over(by) if executable else F.col("close"), "entry_date": F.lead("trade_date", 1).over(by) if executable else F.col("trade_date"), "last": last})
    for h in horizons:
        out = max(h, 2) if executable else h
        status = F.when(F.col("trade_index") + out > F.col("last"), "INSUFFICIENT_FORWARD_WINDOW").when(F.col("entry").isNull(), "MISSING_ENTRY").when(F.col(f"exit_{h}").isNull(), "MISSING_EXIT").when(F.col(f"seen_{h}") < h, "PARTIAL").otherwise("COMPLETE")
        usable = status.isin("COMPLETE", "PARTIAL")
        change = lambda x, ok=usable: F.when(ok, ratio(x - F.col("entry"), "entry"))
        parts.append(F.struct(F.lit(h).alias("horizon"), "entry_date", F.col(f"exit_date_{h}").alias("exit_date"), change(F.col(f"exit_{h}")).alias("ret"), change(F.col(f"low_{h}")).alias("mae"), change(F.col(f"high_{h}")).alias("mfe"), status.alias("status")))
    return df.where("close IS NOT NULL").select("symbol", "trade_date", F.explode(F.array(*parts)).alias("l")).select("symbol", "trade_date", "l.*")


def stacked(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Score columns as rows: (keys, feature, score)."""
    return df.unpivot(list(keys), list(scores), "feature", "score")


def daily_ic(df: DataFrame, keys: Sequence[str] = ("feature",), score: str = "score", ret: str = "ret", least: int = 20) -> DataFrame:
    """Pearson and rank correlation of score and return by keys and day; days with fewer pairs or a constant side are left out."""
    by = [*keys, "trade_date"]
    pairs = df.where(col(score).isNotNull() & col(ret).isNotNull())
    ranked = pairs.withColumn("_rs", average_rank(score, *by)).withColumn("_rr", average_rank(ret, *by))
    day = ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson(score, ret).alias("ic"), pearson("_rs", "_rr").alias("rank_ic"))
    return day.where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(daily: DataFrame, keys: Sequence[str] = ("feature",), value: str = "rank_ic") -> DataFrame:
    """Mean, median, sample sd, ratio of both, positive share, and the p-value of the mean."""
    out = daily.groupBy(*keys).agg(F.count(value).alias("days"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))
    return out.withColumn("ir", ratio("mean", "sd")).withColumn("p_value", normal_p_value(F.col("mean"), F.col("sd"), F.col("days")))


def q_values(tests: DataFrame, p: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """tests with Benjamini-Hochberg q_value, over all or by family; a NULL p counts as 1. One row for each test."""
    keys = [*family] or [F.lit(0)]
    value = F.coalesce(col(p), F.lit(1.0))
    ordered = Window.partitionBy(*keys).orderBy(value, *[c for c in tests.columns if c not in (p, *family)][:1])
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = tests.withColumn("_k", F.row_number().over(ordered)).withColumn("_q", value * m / F.col("_k"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q_value", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_k", "_q")


def quantile_returns(df: DataFrame, keys: Sequence[str], score: str = "score", ret: str = "ret", groups: int = 5, least: int = 20) -> DataFrame:
    """Mean return of each score quantile by day, then averaged over days."""
    by = [*keys, "trade_date"]
    pairs = df.where(col(score).isNotNull() & col(ret).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least)
    cume = F.cume_dist().over(Window.partitionBy(*by).orderBy(col(score)))
    day = pairs.withColumn("quantile", F.least(F.lit(groups), F.ceil(cume * groups))).groupBy(*by, "quantile").agg(F.avg(ret).alias("ret"))
    return day.groupBy(*keys, "quantile").agg(F.count("*").alias("days"), F.avg("ret").alias("ret"))


def bootstrap(daily: DataFrame, value: str, reps: int = 500, block: int = 1, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean by (moving-block) resampling of a series of one row for each day.

    Draws are hashes of (seed, repetition, draw), so re-runs agree.
    """
    series = daily.where(col(value).isNotNull()).select("trade_date", col(value).alias("v"))
    by = Window.orderBy("trade_date")
    series = series.withColumn("i", F.row_number().over(by) - 1)
    total = series.agg(F.count("*").alias("n"))
    spark = daily.sparkSession
    draws = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(total))
    draws = draws.select("rep", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("k"))
    starts = draws.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "rep", "k"), F.greatest(F.col("n") - block + 1, F.lit(1))))
    picks = starts.select("rep", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + block, F.col("n")) - 1)).alias("i"))
    means = picks.join(F.broadcast(series.select("i", "v")), "i").groupBy("rep").agg(F.avg("v").alias("m"))
    ends = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.count("*").alias("reps"), ends.alias("e")).select("reps", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def tail_sums(df: DataFrame, value: str, sizes: Sequence[int]) -> list[float]:
    """Sums of the largest so many values, without sorting them into one task.

    The value at each cut comes from a histogram that is refined until its bin is one value or holds few
    rows; what lies above it is summed, and ties fill what is left.
    """
    out = []
    x = df.select(col(value).cast("double").alias("v")).where("v IS NOT NULL").persist()
    bounds = x.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    for size in sizes:
        if size <= 0 or bounds["a"] is None:
            out.append(0.0)
            continue
        low, high, left = bounds["a"], bounds["b"], size  # the cut is in [low, high], ``left`` values of that range are wanted
        while True:
            width = (high - low) / 1024
            part = x.where(F.col("v").between(low, high))
            if width <= 0 or low + width == low:
                break
            bins = part.groupBy(F.least(F.lit(1023), F.floor((F.col("v") - low) / width)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
            for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # 1,024 rows
                if r["n"] >= left:
                    low, high = r["a"], r["b"]
                    break
                left -= r["n"]
            if low == high:
                break
        above = x.where(F.col("v") > high).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s")).first()["s"]
        out.append(above + left * high)
    x.unpersist()
    return out


def corr_matrix(df: DataFrame, columns: Sequence[str], least: int = 20) -> DataFrame:
    """Pairs (a, b, n, pearson, spearman) from one pass of sums; Spearman ranks each column over its own non-nulls."""
    ranked = _ranked(df, columns)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"), F.col(f"_r_{a}").alias("rx"), F.col(f"_r_{b}").alias("ry")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    long = ranked.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    out = long.groupBy("a", "b").agg(F.count("*").alias("n"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("pearson", "spearman")})


def _ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average ranks of whole columns without a one-partition window: ranks of distinct values from their counts, joined back."""
    out = df.select(*[col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        counts = out.where(col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        ranges = counts.repartitionByRange(c).withColumn("_p", F.spark_partition_id())
        local = Window.partitionBy("_p").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        sums = ranges.withColumn("_c", F.sum("_n").over(local))
        parts = sums.groupBy("_p").agg(F.max("_c").alias("_t"))
        before = parts.withColumn("_o", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
        ranks = sums.join(F.broadcast(before), "_p").select(c, (F.col("_o") + F.col("_c") - F.col("_n") + 1 + (F.col("_n") - 1) / 2.0).alias(f"_r_{c}"))
        out = out.join(ranks, c, "left")
    return out


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component; for graphs of features, sources or clusters.

    Labels travel over edges; all nodes of a label then take the smallest label that any of them met, and that
    label's own, so whole groups join at once and chains close in a few rounds. Rounds are checkpointed in spark.checkpoint.dir, which must be set.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")).checkpoint()
        up = hooked.groupBy("was").agg(F.min("component").alias("up"))
        far = up.join(up.select(F.col("was").alias("up"), F.col("up").alias("far")), "up").select("was", "far")
        jumped = hooked.join(far, "was").select("node", F.col("far").alias("component"), "was").checkpoint()
        labels = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _residual_from(d, y, a, b, s) -> Column:
    det = s(a, a) * s(b, b) - s(a, b) * s(a, b)
    ba = ratio(s(b, b) * s(a, y) - s(a, b) * s(b, y), det)
    bb = ratio(s(a, a) * s(b, y) - s(a, b) * s(a, y), det)
    return d[y] - ba * d[a] - bb * d[b]


def with_residual(df: DataFrame, y: str, a: str, b: str, by: Sequence[str], name: str = "residual") -> DataFrame:
    """df with the residual of y on controls a and b within groups; demeaned columns first, as windows don't nest."""
    w = Window.partitionBy(*by)
    flat = df.withColumns({f"_{c}": col(c) - F.avg(c).over(w) for c in (y, a, b)})
    s = lambda p, q: F.avg(F.col(f"_{p}") * F.col(f"_{q}")).over(w)
    out = flat.withColumn(name, _residual_from({c: F.col(f"_{c}") for c in (y, a, b)}, y, a, b, s))
    return out.drop(*[f"_{c}" for c in (y, a, b)])


def folds(days: DataFrame, count: int, train: int, test: int, embargo: int) -> DataFrame:
    """(trade_date, fold, role): expanding training windows, an embargo, then test dates. days(trade_date, trade_index)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("fold")
    end = F.lit(train) + F.col("fold") * test
    role = F.when(F.col("trade_index") <= end, "TRAIN").when(F.col("trade_index") <= end + embargo, "EMBARGO").when(F.col("trade_index") <= end + embargo + test, "TEST")
    return days.select("trade_date", "trade_index", k).withColumn("role", role).where("role IS NOT NULL")


def ridge(gram: np.ndarray, right: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients on raw features of a ridge on standardised ones; the constant isn't penalised."""
    n, mean = gram[0, 0], gram[0] / gram[0, 0]
    sd = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 1e-12))[1:]
    z = (gram[1:, 1:] - n * np.outer(mean[1:], mean[1:])) / np.outer(sd, sd)
    t = (right[1:] - mean[1:] * right[0]) / sd
    b = np.linalg.solve(z + penalty * np.eye(len(sd)), t) / sd
    return np.concatenate([[right[0] / n - b @ mean[1:]], b])


def capped_weights(raw: Column, cap: float, rounds: int = 8) -> Column:
    """An array of non-negative weights scaled to 1 with none above cap; what is cut goes to the others in proportion."""

    def again(w: Column) -> Column:
        over = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.greatest(x - cap, F.lit(0.0)))
        free = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.when(x < cap, x).otherwise(0.0))
        return F.transform(w, lambda x: F.when(x >= cap, F.lit(cap)).otherwise(x + F.coalesce(F.try_divide(x * over, F.nullif(free, F.lit(0.0))), F.lit(0.0))))

    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    first = F.transform(raw, lambda x: F.coalesce(F.try_divide(x, F.nullif(total, F.lit(0.0))), F.lit(0.0)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda w, _: again(w))


def segment_nav(prices: DataFrame, targets: DataFrame, cost: float = 0.0) -> DataFrame:
    """(trade_date, nav): weights drift between rebalances, turnover costs at each; closed form by segment, no loop over days.

    prices(symbol, trade_date, trade_index, close); targets(rebalance_index, symbol, weight), the rest is cash. So is the
    weight of a target without a positive price at its rebalance, as it can't be bought.
    """
    points = targets.select("rebalance_index").distinct().withColumn("next_index", F.lead("rebalance_index").over(Window.orderBy("rebalance_index")))
    base = prices.where("close > 0").select("symbol", F.col("trade_index").alias("rebalance_index"), F.col("close").alias("base"))
    targets = targets.join(base, ["rebalance_index", "symbol"])
    held = targets.join(F.broadcast(points), "rebalance_index").withColumnRenamed("rebalance_index", "segment")
    p = prices.select(F.col("symbol").alias("_key"), "trade_date", "trade_index", "close")
    inside = held.join(p, (F.col("symbol") == F.col("_key")) & (F.col("trade_index") >= F.col("segment")) & (F.col("next_index").isNull() | (F.col("trade_index") <= F.col("next_index")))).drop("_key")
    grown = inside.withColumn("value", F.col("weight") * F.col("close") / F.col("base"))
    day = grown.groupBy("segment", "trade_date", "trade_index", "next_index").agg((F.lit(1.0) + F.sum("value") - F.sum("weight")).alias("growth"))
    # turnover at a segment's end: next targets against drifted weights
    end = grown.where("trade_index = next_index").select("segment", "symbol", "value", "next_index")
    total = day.where("trade_index = next_index").select("segment", F.col("growth").alias("total"))
    drifted = end.join(total, "segment").select(F.col("next_index").alias("rebalance_index"), "symbol", ratio("value", "total").alias("drifted"))
    turn = targets.join(drifted, ["rebalance_index", "symbol"], "full").groupBy("rebalance_index").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))).alias("turnover"))
    segments = points.join(day.where("trade_index = next_index").select(F.col("segment").alias("rebalance_index"), "growth"), "rebalance_index", "left").join(turn, "rebalance_index", "left")
    before = Window.orderBy("rebalance_index").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("rebalance_index").rowsBetween(Window.unboundedPreceding, 0)
    start = F.exp(F.coalesce(F.sum(F.ln("growth")).over(before), F.lit(0.0)) + F.sum(F.ln(1 - F.lit(cost) * F.coalesce("turnover", F.lit(0.0)))).over(upto))
    starts = segments.select(F.col("rebalance_index").alias("segment"), start.alias("start_nav"))
    out = day.where(F.col("next_index").isNull() | (F.col("trade_index") < F.col("next_index")))
    return out.join(F.broadcast(starts), "segment").select("trade_date", (F.col("start_nav") * F.col("growth")).alias("nav"))


def folded_positions(trades: DataFrame, keys: Sequence[str] = ("portfolio", "symbol")) -> DataFrame:
    """(keys, quantity, average_cost, realised, fees) from trades(keys, trade_id, side, quantity, price, fee, traded_on, status).

    Corrected and reversed trades (status not NULL) are dropped. A fold over each key's ordered
    trades: buys average the cost, sells realise, crossing zero opens at the trade's price.
    """
    live = trades.where("status IS NULL")
    t = F.struct(F.col("traded_on"), F.col("trade_id"), F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).alias("q"), F.col("price"), F.col("fee"))
    own = live.groupBy(*keys).agg(F.array_sort(F.collect_list(t)).alias("_t"))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"), F.lit(0.0).alias("p"), F.lit(0.0).alias("f"))

    def step(s: Column, x: Column) -> Column:
        new = s["q"] + x["q"]
        same = s["q"] * x["q"] >= 0
        closed = F.least(F.abs(s["q"]), F.abs(x["q"]))
        gain = F.when(same, 0.0).otherwise(closed * (x["price"] - s["c"]) * F.signum(s["q"]))
        cost = F.when(new == 0, 0.0).when(same, (s["q"] * s["c"] + x["q"] * x["price"]) / F.when(new == 0, 1.0).otherwise(new)).when(s["q"] * new > 0, s["c"]).otherwise(x["price"])
        return F.struct(new.alias("q"), cost.alias("c"), (s["p"] + gain).alias("p"), (s["f"] + x["fee"]).alias("f"))

    end = own.withColumn("_e", F.aggregate("_t", start, step))
    return end.select(*keys, F.col("_e.q").alias("quantity"), F.col("_e.c").alias("average_cost"), F.col("_e.p").alias("realised"), F.col("_e.f").alias("fees"))

