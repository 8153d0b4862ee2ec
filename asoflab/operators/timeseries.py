"""Features of a symbol over its own dates: ``by`` orders a symbol's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from asoflab.functions.columns import change, clip, col, full, ratio, trailing


def __getattr__(name: str) -> WindowSpec:
    """SYMBOL: a symbol's rows by date. Windows need a session, so it is made when asked for."""
    if name == "SYMBOL":
        return Window.partitionBy("symbol").orderBy("trade_date")
    raise AttributeError(name)


def _by(by: WindowSpec | None) -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date") if by is None else by


def path_features(bars: DataFrame, by: WindowSpec | None = None) -> DataFrame:
    """Returns, gap, intraday move, amplitude, close location and volume change; each NULL on a zero or missing base."""
    by = _by(by)
    pc = F.lag("close").over(by)
    with_previous = bars.withColumn("previous_close", pc).withColumn("previous_volume", F.lag("volume").over(by))
    return with_previous.withColumns({
        "ret": change("close", "previous_close"), "open_gap": change("open", "previous_close"), "intraday": change("close", "open"),
        "amplitude": ratio(F.col("high") - F.col("low"), "previous_close"), "close_location": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "high_to_close": change("close", "high"), "low_to_close": change("close", "low"), "volume_change": change("volume", "previous_volume"),
    })


def gap_split(gap: str | Column, intraday: str | Column) -> tuple[Column, Column]:
    """Follow-through and fade: the positive and the negative part of sign(gap) * intraday."""
    along = F.signum(col(gap)) * col(intraday)
    return F.greatest(along, F.lit(0.0)), F.greatest(-along, F.lit(0.0))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often it is used: columns are copied into each use, windows and folds too."""
    return F.transform(F.array(value), then)[0]


def history(x: str | Column, by: WindowSpec, n: int) -> Column:
    """The last n values, oldest first."""
    return F.collect_list(col(x)).over(trailing(by, n))


def ema_weights(period: int, n: int) -> list[float]:
    """Weights of a finite exponential mean seeded with the oldest of n values."""
    a = 2.0 / (period + 1)
    return [(1 - a) ** (n - 1), *[a * (1 - a) ** (n - 1 - k) for k in range(1, n)]]


def ema_finite(x: str | Column, by: WindowSpec, period: int, n: int = 60) -> Column:
    """EMA over the last n values as a fixed weight vector; NULL until there are n."""
    weights = F.array(*[F.lit(w) for w in ema_weights(period, n)])
    return once(history(x, by, n), lambda values: F.when(F.size(values) == n, F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)))


def macd_weights(n: int = 60) -> dict[str, list[float]]:
    """MACD is linear in the values of a window: weights of DIF (12/26 means seeded with the oldest value) and
    DEA (9, seeded with 0) by age, and what the oldest value gets besides, by the number of values."""
    fast, slow, signal = 11.0 / 13, 25.0 / 27, 0.8
    dif = [(1 - fast) * fast**k - (1 - slow) * slow**k for k in range(n)]
    seed = [fast**k - slow**k for k in range(n)]  # of the oldest value in DIF, k values after it
    smooth = lambda own, upto: sum((1 - signal) * signal ** (upto - i) * own[i] for i in range(upto + 1))
    dea = [smooth(dif, k) for k in range(n)]
    dea_seed = [smooth([0.0, *seed[1:]], k) for k in range(n)]
    return {"dif": dif, "dea": dea, "dif_more": [s - d for s, d in zip(seed, dif, strict=True)], "dea_more": [s - d for s, d in zip(dea_seed, dea, strict=True)]}


def macd(values: Column, n: int = 60) -> Column:
    """Struct (dif, dea, histogram, state) of an array of at most n values, oldest first: histogram is twice
    DIF less DEA; state GOLDEN or DEAD by its sign, else FLAT."""
    w = {k: F.array(*[F.lit(x) for x in v]) for k, v in macd_weights(n).items()}

    def of(values: Column) -> Column:
        size = F.size(values)

        def weighed(newest_first: Column, name: str) -> Column:
            products = F.zip_with(newest_first, F.slice(w[name], 1, size), lambda v, x: v * x)
            return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + F.get(values, F.lit(0)) * F.get(w[f"{name}_more"], size - 1)

        pair = once(F.reverse(values), lambda back: F.struct(weighed(back, "dif").alias("dif"), weighed(back, "dea").alias("dea")))
        whole = once(pair, lambda m: F.struct(m["dif"].alias("dif"), m["dea"].alias("dea"), ((m["dif"] - m["dea"]) * 2).alias("histogram")))
        state = lambda h: F.when(h > 0, "GOLDEN").when(h < 0, "DEAD").otherwise("FLAT")
        return F.when(size > 0, once(whole, lambda m: F.struct(m["dif"].alias("dif"), m["dea"].alias("dea"), m["histogram"].alias("histogram"), state(F.round(m["histogram"], 4)).alias("state"))))

    return once(values, of)


def rsi_simple(x: str, by: WindowSpec, n: int = 14) -> Column:
    """From the mean gain and loss of n changes; 100 without losses; NULL when short. Needs column ``delta``, the change."""
    frame = trailing(by, n)
    gain, loss = F.avg(F.greatest(col(x), F.lit(0.0))).over(frame), F.avg(F.greatest(-col(x), F.lit(0.0))).over(frame)
    return full(F.when(loss == 0, 100.0).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(gain, loss))), col(x), frame, n)


def rsi_wilder(values: Column, n: int = 14) -> Column:
    """Wilder's RSI inside an array of closes: seeded with the first n changes, then smoothed."""
    up = lambda part, sign: F.aggregate(part, F.lit(0.0), lambda s, d: s + F.greatest(d * sign, F.lit(0.0))) / F.lit(float(n))
    smooth = lambda s, d: F.struct(((s["g"] * (n - 1) + F.greatest(d, F.lit(0.0))) / n).alias("g"), ((s["l"] * (n - 1) + F.greatest(-d, F.lit(0.0))) / n).alias("l"))

    def smoothed(deltas: Column) -> Column:
        head, tail = F.slice(deltas, 1, n), F.slice(deltas, n + 1, F.greatest(F.size(deltas) - n, F.lit(0)))
        return once(head, lambda h: F.aggregate(tail, F.struct(up(h, 1.0).alias("g"), up(h, -1.0).alias("l")), smooth))

    def of(values: Column) -> Column:
        deltas = F.zip_with(F.slice(values, 2, F.size(values) - 1), F.slice(values, 1, F.size(values) - 1), lambda b, a: b - a)
        end = once(deltas, smoothed)
        told = once(end, lambda e: F.when(e["l"] == 0, 100.0).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(e["g"], e["l"]))))
        return F.when(F.size(values) > n, told)

    return once(values, of)


def kdj(rsv: Column) -> Column:
    """Struct (k, d, j, crossed) of an array of raw stochastic values, oldest first, from 50/50; crossed: K falls below D from above 70."""
    start = F.struct(F.lit(50.0).alias("k"), F.lit(50.0).alias("d"), F.lit(50.0).alias("k0"), F.lit(50.0).alias("d0"))

    def step(s: Column, v: Column) -> Column:
        k = s["k"] * (2.0 / 3) + v / 3.0
        return F.struct(k.alias("k"), (s["d"] * (2.0 / 3) + k / 3.0).alias("d"), s["k"].alias("k0"), s["d"].alias("d0"))

    def told(end: Column) -> Column:
        crossed = (end["k0"] >= end["d0"]) & (end["k"] < end["d"]) & (end["k0"] > 70)
        return F.struct(end["k"].alias("k"), end["d"].alias("d"), (end["k"] * 3 - end["d"] * 2).alias("j"), crossed.alias("crossed"))

    return once(F.aggregate(rsv, start, step), told)


def true_range(high: str, low: str, previous_close: str) -> Column:
    h, l, c = F.col(high), F.col(low), F.col(previous_close)
    return F.greatest(h - l, F.abs(h - c), F.abs(l - c))


def volatility(by: WindowSpec, log_return: str = "log_return", n: int = 20, year: int = 252) -> Column:
    frame = trailing(by, n)
    return full(F.stddev_samp(log_return).over(frame) * F.sqrt(F.lit(float(year))), F.col(log_return), frame, n)


def with_streak(df: DataFrame, condition: Column, name: str, by: WindowSpec | None = None) -> DataFrame:
    """df with the running length of the condition, by the index of its last break."""
    by = _by(by)
    held = F.coalesce(condition, F.lit(False))
    numbered = df.withColumn("_n", F.row_number().over(by)).withColumn("_break", F.when(~held, F.col("_n")))
    last = F.coalesce(F.max("_break").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return numbered.withColumn(name, (F.col("_n") - last).cast("long")).drop("_n", "_break")


def share_not_above(x: str, by: WindowSpec, n: int) -> Column:
    """Share of the n values before this one that are at most this one; NULL unless there are n."""
    before = F.collect_list(x).over(by.rowsBetween(-n, -1))
    return F.when((F.size(before) == n) & F.col(x).isNotNull(), F.size(F.filter(before, lambda v: v <= F.col(x))) / F.lit(float(n)))


def ratio_to_prior_mean(x: str, by: WindowSpec, n: int) -> Column:
    """x over the mean of the n values before it, all of which must be positive."""
    frame = by.rowsBetween(-n, -1)
    positive = F.when(F.col(x) > 0, F.col(x))
    return F.when(F.count(positive).over(frame) == n, ratio(F.col(x), F.avg(positive).over(frame)))


def move_state(x: str, flat: float = 0.0) -> Column:
    return F.when(F.col(x) > flat, "UP").when(F.col(x) < -flat, "DOWN").when(F.col(x).isNotNull(), "FLAT")


def technical_score(sma20: str, sma60: str, ema12: str, ema26: str, rsi: str) -> Column:
    """Half trend, a third momentum, the rest RSI, which turns against the score above 75."""
    r = F.when(F.col(rsi) > 75, -0.5).otherwise(clip((F.col(rsi) - 50) / 25))
    trend = clip((ratio(sma20, sma60) - 1) * 12)
    momentum = clip((ratio(ema12, ema26) - 1) * 25)
    return clip(trend * 0.5 + momentum * 0.35 + r * 0.15)


def forward_adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times factor over the symbol's last factor; a symbol that lacks any factor keeps its raw prices.

    factors(symbol, trade_date, adj_factor), one row each.
    """
    whole = Window.partitionBy("symbol")
    joined = bars.join(factors.select("symbol", "trade_date", "adj_factor"), ["symbol", "trade_date"], "left")
    last = F.max_by("adj_factor", F.when(F.col("adj_factor").isNotNull(), F.col("trade_date"))).over(whole)
    complete = F.count("adj_factor").over(whole) == F.count(F.lit(1)).over(whole)
    scale = F.when(complete, ratio("adj_factor", last)).otherwise(F.lit(1.0))
    out = joined.withColumn("_scale", scale).withColumn("adjusted", complete)
    return out.withColumns({c: F.col(c) * F.col("_scale") for c in ("open", "high", "low", "close")}).drop("_scale")


def event_intervals(events: DataFrame) -> DataFrame:
    """Suspensions (S) up to the next resumption (R) of the symbol; repeated S within one belong to it; an open end is NULL.

    events(symbol, at, kind, event_id).
    """
    by = Window.partitionBy("symbol").orderBy("at", "event_id")
    marked = events.withColumn("_new", (F.col("kind") == "S") & (F.coalesce(F.lag("kind").over(by), F.lit("R")) != "S"))
    island = marked.withColumn("_island", F.sum(F.col("_new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_island > 0")
    return island.groupBy("symbol", "_island").agg(F.min(F.when(F.col("kind") == "S", F.col("at"))).alias("start"), F.min(F.when(F.col("kind") == "R", F.col("at"))).alias("end")).drop("_island")
