"""Walk-forward research: purged ridge, rolling factor weights, and candidates on a lattice of parameters with their evaluation.

Every table that a window here takes without a key, or by candidate, holds one row for each date.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import col, pearson, ratio
from asoflab.operators.evaluate import ridge
from asoflab.sources import shared

#: Dates between the last training label's row and the first predicted one: labels run 20 sessions ahead.
PURGE = 25
#: Weights of the factors without any estimate, and their bounds.
BASELINE, LOWER, UPPER = (0.6, 0.4, 0.0), (0.35, 0.2, 0.0), (0.7, 0.5, 0.3)


def date_places(df: DataFrame) -> DataFrame:
    """(trade_date, place): the dates of df, numbered from 0."""
    return df.select("trade_date").distinct().select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("place"))


def day_rank(x: str, *keys: str) -> Column:
    """Average rank over the number of rows of a column without NULLs; ties are counted in the frame of the rank itself, so one sort does."""
    by = Window.partitionBy(*keys).orderBy(x)
    ties = F.count(F.lit(1)).over(by.rangeBetween(Window.currentRow, Window.currentRow))
    return (F.rank().over(by) + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def moment_sums(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(place, sums): for each date the cross products of a constant, features and target, and for all dates before it their running sums.

    df(trade_date, place, features, target). Rows with a NULL in any of them add nothing. One row for each date leaves the
    aggregation, so the running sums go over dates, not rows.
    """
    names = [F.lit(1.0), *[col(f).cast("double") for f in features], col(target).cast("double")]
    whole = F.lit(True)
    for x in names[1:]:
        whole = whole & x.isNotNull()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    day = df.groupBy("place").agg(*[F.coalesce(F.sum(F.when(whole, names[i] * names[j])), F.lit(0.0)).alias(f"s{k}") for k, (i, j) in enumerate(pairs)])
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("place", F.array(*[F.sum(f"s{k}").over(upto) for k in range(len(pairs))]).alias("sums"))


def purged_ridge(df: DataFrame, features: Sequence[str], target: str, window: int = 100, block: int = 40, purge: int = PURGE, penalty: float = 1.0) -> DataFrame:
    """(symbol, trade_date, block, prediction): blocks of ``block`` dates, each predicted by a ridge on the ``window`` dates that
    end ``purge`` dates before it, features standardised on them; dates before the first whole window have no prediction.

    A block's normal equations are the difference of two running sums; tasks solve them, one small system a block, and
    coefficients (a row for each block) are broadcast. df(symbol, trade_date, features, target), target NULL where unknown.
    """
    rows = df.join(F.broadcast(date_places(df)), "trade_date")
    sums = moment_sums(rows, features, target)
    first = window + purge
    starts = sums.where((F.col("place") >= first) & ((F.col("place") - first) % block == 0)).select("place")
    ends = starts.select(F.col("place").alias("start"), F.explode(F.array(F.struct((F.col("place") - purge - 1).alias("place"), F.lit(1.0).alias("sign")), F.struct((F.col("place") - purge - window - 1).alias("place"), F.lit(-1.0).alias("sign")))).alias("e")).select("start", "e.*")
    parts = ends.join(sums, "place")  # the sum before the first date is nothing, and has no row
    k = len(features) + 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for start, own in zip(b["start"], b["sums"], strict=True):
                full = np.zeros((k + 1, k + 1))
                full[np.triu_indices(k + 1)] = own
                full = full + np.triu(full, 1).T
                if full[0, 0] >= 1:
                    out.append((start, ridge(full[:k, :k], full[:k, k], penalty).tolist()))
            yield pd.DataFrame(out, columns=["start", "beta"])

    n = (k + 1) * (k + 2) // 2
    taken = parts.groupBy("start").agg(F.array(*[F.sum(F.col("sign") * F.col("sums")[i]) for i in range(n)]).alias("sums"))
    betas = taken.mapInPandas(solve, "start int, beta array<double>")
    x = F.array(F.lit(1.0), *[col(f).cast("double") for f in features])
    inner = F.aggregate(F.zip_with(x, "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    placed = rows.where(F.col("place") >= first).withColumn("start", (F.col("place") - (F.col("place") - first) % block).cast("int"))
    return placed.join(F.broadcast(betas), "start").select("symbol", "trade_date", ((F.col("start") - first) / block).cast("long").alias("block"), inner.alias("prediction"))


def factor_ic(df: DataFrame, factors: Sequence[str], ret: str, least: int) -> DataFrame:
    """(trade_date, factors...): correlation of each factor with the day's return ranks, NULL where constant or on fewer than ``least`` rows; one shuffle."""
    ranked = df.where(col(ret).isNotNull()).withColumn("_r", day_rank(ret, "trade_date"))
    n = F.count("*")
    return ranked.groupBy("trade_date").agg(*[F.when(n >= least, pearson(f, "_r")).alias(f) for f in factors])


def rolling_weights(daily: DataFrame, factors: Sequence[str], windows: Sequence[int], shrinks: Sequence[float], purge: int = PURGE) -> DataFrame:
    """(trade_date, method, window, shrink, weights) from daily(trade_date, factors...) of ``factor_ic``.

    The window ends ``purge`` + 1 rows before the date. Raw weights are the mean (ROLLING_RANK_IC), mean over sd (RANK_IC_IR)
    or mean over 1 + sd (STABILITY); what is positive is normalised, mixed with the baseline by ``shrink``, clipped and
    normalised again. Dates without a whole window before the gap have none.
    """
    by = Window.orderBy("trade_date")
    d = daily.withColumn("_k", F.row_number().over(by) - 1)
    methods = []
    for w in windows:
        past = by.rowsBetween(-(purge + w), -(purge + 1))
        means = [F.avg(f).over(past) for f in factors]
        sds = [F.stddev_samp(f).over(past) for f in factors]
        raw = {
            "ROLLING_RANK_IC": means, "RANK_IC_IR": [F.coalesce(ratio(m, s), F.lit(0.0)) for m, s in zip(means, sds, strict=True)],
            "STABILITY": [m / (1 + F.coalesce(F.when(s > 0, s), F.lit(1.0))) for m, s in zip(means, sds, strict=True)],
        }
        name = {m: f"_{m}_{w}" for m in raw}
        d = d.withColumns({name[m]: F.when(F.col("_k") >= purge + w, F.transform(F.array(*v), lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))) for m, v in raw.items()})
        methods += [F.struct(F.lit(m).alias("method"), F.lit(w).alias("window"), F.col(c).alias("raw")) for m, c in name.items()]
    long = d.select("trade_date", F.explode(F.array(*methods)).alias("m")).select("trade_date", "m.*").where("raw IS NOT NULL")
    long = long.withColumn("shrink", F.explode(F.array(*map(F.lit, shrinks))))
    constant = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x)
    estimated = F.when(total > 0, F.transform("raw", lambda x: x / total)).otherwise(constant(BASELINE))
    mixed = F.zip_with(constant(BASELINE), estimated, lambda b, e: F.col("shrink") * b + (1 - F.col("shrink")) * e)
    held = F.transform(F.arrays_zip(mixed.alias("x"), constant(LOWER).alias("a"), constant(UPPER).alias("b")), lambda z: F.greatest(z["a"], F.least(z["b"], z["x"])))
    long = long.withColumn("held", held)
    return long.select("trade_date", "method", "window", "shrink", F.transform("held", lambda x: x / F.aggregate("held", F.lit(0.0), lambda s, y: s + y)).alias("weights"))


def _rank(x: np.ndarray) -> np.ndarray:
    """Average rank over the number of values."""
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
    sizes = np.diff(np.r_[starts, len(x)])
    out = np.empty(len(x))
    out[order] = np.repeat(starts + 1 + (sizes - 1) / 2.0, sizes) / len(x)
    return out


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    if x.min() == x.max() or y.min() == y.max():
        return np.nan
    a, b = x - x.mean(), y - y.mean()
    spread = np.sqrt((a @ a) / len(a)) * np.sqrt((b @ b) / len(b))
    return (a @ b) / len(a) / spread if spread else np.nan


DAYS = "candidate string, trade_date date, n long, ic double, rank_ic double, spread double, selected long, gross double, exposure double"


def _day(factors: Sequence[str]):
    """A day's rows under the weights of all of its candidates; ranks of returns are taken once."""

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, out = [c.split()[0] for c in DAYS.split(", ")], []
        if len(rows) and len(own):
            x, ret, risk = rows[list(factors)].to_numpy(float).T, rows["ret"].to_numpy(float), rows["risk"].to_numpy(bool)
            ranks, mean = _rank(ret), lambda v: v.mean() if len(v) else np.nan
            for candidate, weights, penalty, risk_scale in zip(own["candidate"], own["weights"], own["penalty"], own["risk_scale"], strict=True):
                score = weights[0] * x[0]
                for w, v in zip(weights[1:], x[1:], strict=True):
                    score = score + w * v
                score = score - penalty * risk
                score = np.copysign(np.floor(np.abs(score) * 1e9 + 0.5) / 1e9, score)
                scale, s = np.where(risk, risk_scale, 1.0), _rank(score)
                best = s > 0.9
                out.append((candidate, rows["trade_date"].iat[0], len(rows), _correlation(score, ret), _correlation(s, ranks), mean(ret[best]) - mean(ret[s <= 0.1]), int(best.sum()), mean((ret * scale)[best]), mean(scale[best])))
        return pd.DataFrame(out, columns=names)

    return run


def scored_days(df: DataFrame, weights: DataFrame, factors: Sequence[str], risk: str) -> DataFrame:
    """One row for each candidate and day: n, ic, rank_ic, spread of the outer tenths, size, gross return and exposure of the best tenth.

    df(trade_date, factors, risk, ret) scored by weights(candidate, trade_date, weights, penalty, risk_scale), a row for each candidate
    and date; scores are rounded to nine digits. A day's rows move once for all candidates. Rows with a NULL score or return don't count.
    """
    shared.importable(df.sparkSession)
    rows = df.select("trade_date", *[col(f).cast("double").alias(f) for f in factors], col(risk).alias("risk"), "ret").dropna()
    own = weights.select(F.col("trade_date").alias("day"), "candidate", "weights", "penalty", "risk_scale")
    return rows.groupBy("trade_date").cogroup(own.groupBy("day")).applyInPandas(_day(factors), DAYS)


def traded_days(days: DataFrame, keys: Sequence[str], least: int = 100, every: int = 20) -> DataFrame:
    """Days of ``scored_days`` by keys with at least so many rows; gross and exposure stand only on every ``every``-th date of the keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("trade_date")) - 1
    day = days.withColumn("traded", (place % every == 0) & (F.col("selected") > 0)).where(F.col("n") >= least)
    return day.withColumns({c: F.when(F.col("traded"), F.col(c)) for c in ("gross", "exposure")})


def candidate_days(scored: DataFrame, keys: Sequence[str], least: int = 100, every: int = 20) -> DataFrame:
    """One row for each candidate and day from scored(keys, trade_date, symbol, score, ret, scale): n, ic, rank_ic, spread of the
    outer tenths, and on every ``every``-th of its dates gross return and exposure of the best tenth. Days of fewer rows are left out."""
    by = [*keys, "trade_date"]
    work = scored.where("score IS NOT NULL AND ret IS NOT NULL").withColumns({"_s": day_rank("score", *by), "_r": day_rank("ret", *by)})
    best, worst = F.col("_s") > 0.9, F.col("_s") <= 0.1
    day = work.groupBy(*by).agg(
        F.count("*").alias("n"), pearson("score", "ret").alias("ic"), pearson("_s", "_r").alias("rank_ic"), (F.avg(F.when(best, F.col("ret"))) - F.avg(F.when(worst, F.col("ret")))).alias("spread"),
        F.count_if(best).alias("selected"), F.avg(F.when(best, F.col("ret") * F.col("scale"))).alias("gross"), F.avg(F.when(best, F.col("scale"))).alias("exposure"),
    )
    return traded_days(day, keys, least, every)


def candidate_metrics(days: DataFrame, keys: Sequence[str], costs: Sequence[int] = (0, 20, 40, 60), year: float = 252.0 / 20.0) -> DataFrame:
    """One row for each candidate and cost in basis points: diagnostics of all days, and return, risk and stability of the traded ones."""
    own = days.groupBy(*keys).agg(F.sum("n").alias("observations"), F.count("*").alias("valid_dates"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), (ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")) * F.sqrt(F.lit(252.0))).alias("ic_ir"), F.avg("spread").alias("spread"))
    traded = days.where("traded").withColumn("cost_bp", F.explode(F.array(*map(F.lit, costs)))).withColumn("net", F.col("gross") - F.col("exposure") * F.col("cost_bp") / 10000.0)
    by = [*keys, "cost_bp"]
    path = Window.partitionBy(*by).orderBy("trade_date")
    log = F.ln(F.greatest(1 + F.col("net"), F.lit(1e-8)))
    traded = traded.withColumn("value", F.exp(F.sum(log).over(path.rowsBetween(Window.unboundedPreceding, 0))))
    traded = traded.withColumn("fall", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(path.rowsBetween(Window.unboundedPreceding, -1))) - 1)
    x = F.col("net")
    down = F.stddev_samp(F.when(x < 0, x))
    stats = traded.groupBy(*by).agg(
        F.count("*").alias("periods"), F.sum("selected").alias("trades"), F.avg(x).alias("mean_return"), F.stddev_samp(x).alias("_sd"), down.alias("_down"), F.sum(log).alias("_log"), F.min("fall").alias("max_drawdown"),
        F.avg((x > 0).cast("double")).alias("win_rate"), ratio(F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0))).alias("profit_factor"), F.percentile(x, F.lit(0.05)).alias("tail_loss"), F.avg("exposure").alias("turnover"),
    )
    for name, unit in (("monthly", "month"), ("yearly", "year")):
        part = traded.groupBy(*by, F.trunc("trade_date", unit).alias("_p")).agg(F.sum(log).alias("_l")).groupBy(*by).agg(F.avg((F.col("_l") > 0).cast("double")).alias(f"{name}_stability"))
        stats = stats.join(part, by)
    annual = F.exp(F.col("_log") * year / F.col("periods")) - 1
    stats = stats.withColumns({"annualized_return": annual, "sharpe": ratio("mean_return", "_sd") * F.sqrt(F.lit(year)), "sortino": ratio("mean_return", "_down") * F.sqrt(F.lit(year)), "calmar": ratio(annual, F.abs("max_drawdown"))})
    return own.join(stats.drop("_sd", "_down", "_log"), list(keys))


def family_best(metrics: DataFrame, definitions: DataFrame, cost: int = 40) -> DataFrame:
    """The candidate of each family with the best Sharpe, then rank IC, then name; figures that agree to nine digits are equal. definitions(candidate, family, ...)."""
    at = metrics.where(F.col("cost_bp") == cost).join(F.broadcast(definitions), "candidate")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc_nulls_last(F.round("sharpe", 9)), F.desc_nulls_last(F.round("rank_ic", 9)), "candidate"))
    return at.withColumn("_place", place).where("_place = 1").drop("_place")


def neighbour_passes(best: DataFrame, metrics: DataFrame, definitions: DataFrame, axes: dict[str, dict[str, tuple[str, float]]], legacy: str, margin: float = 0.15, least_ic: float = 0.02, cost: int = 40) -> DataFrame:
    """(family, candidate, neighbours, passes, pass_ratio): how many of the best candidate's neighbours beat the legacy one's Sharpe by ``margin`` with enough rank IC.

    axes: by family {name: (kind, reach)} over definitions' map of numbers ``params``: 'total' axes together differ by at most
    reach, 'each' axes by at most reach each; 'same' axes are equal. Families without axes are neighbours as a whole.
    The join is of families' best rows with their own family only; candidates are tens.
    """
    at = metrics.where(F.col("cost_bp") == cost).select("candidate", "sharpe", "rank_ic").join(F.broadcast(definitions.select("candidate", "family", "params")), "candidate")
    base = at.where(F.col("candidate") == legacy).select(F.col("sharpe").alias("_legacy"))
    pairs = best.select("family", "candidate", F.col("params").alias("_own")).join(at.select("family", F.col("candidate").alias("_other"), "params", "sharpe", "rank_ic"), "family")
    near = F.lit(True)
    for family, rules in axes.items():
        gap = lambda n: F.abs(F.col("_own")[n] - F.col("params")[n])
        ok, total, reach = F.lit(True), F.lit(0.0), None
        for name, (kind, most) in rules.items():
            if kind == "total":
                total, reach = total + gap(name), most
            else:
                ok = ok & (gap(name) <= (most if kind == "each" else 0.0) + 1e-7)
        ok = ok & (total <= reach + 1e-7) if reach is not None else ok
        near = near & F.when(F.col("family") == family, F.coalesce(ok, F.lit(False))).otherwise(True)
    passed = (F.col("sharpe") >= F.col("_legacy") + margin) & (F.col("rank_ic") >= least_ic)
    told = pairs.where(near).join(F.broadcast(base))  # one row
    out = told.groupBy("family", "candidate").agg(F.count("*").alias("neighbours"), F.count_if(passed).alias("passes"))
    return out.withColumn("pass_ratio", F.col("passes") / F.col("neighbours"))


def matched_baseline(best: DataFrame, days: DataFrame, legacy: str, least: int, costs: Sequence[int] = (40,)) -> DataFrame:
    """Metrics of the legacy score on the dates that each best candidate has with enough rows: a join of dates for each family."""
    own = days.where(F.col("n") >= least).join(F.broadcast(best.select("candidate", "family")), "candidate").select("family", "trade_date").distinct()
    rows = days.where(F.col("candidate") == legacy).drop("candidate").join(F.broadcast(own), "trade_date")  # a row for each family and date
    return candidate_metrics(traded_days(rows, ["family"], least), ["family"], costs)


def fold_days(days: DataFrame, dates: DataFrame, windows: Sequence[int], block: int = 40, purge: int = PURGE) -> DataFrame:
    """Days of ``scored_days`` once for each training window, with train_window and fold: blocks of dates that start ``window`` + ``purge`` dates in."""
    w = days.join(F.broadcast(dates), "trade_date").withColumn("train_window", F.explode(F.array(*map(F.lit, windows))))
    first = F.col("train_window") + purge
    return w.where(F.col("place") >= first).withColumn("fold", F.floor((F.col("place") - first) / block)).drop("place")
