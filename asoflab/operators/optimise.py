"""Optimised weights of small portfolios: minimum variance, maximum Sharpe ratio and hierarchical risk parity."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("MIN_VARIANCE", "MAX_SHARPE", "HRP")
#: A portfolio of more assets is an error: its covariances would be one task's work.
MOST_ASSETS = 500


def lookback_rows(returns: DataFrame, window: int, step: int) -> DataFrame:
    """returns(portfolio, symbol, trade_index, ret) with rebalance, once for each rebalance whose lookback holds the row.

    Rebalances are at every step-th trading day that there is, and see the window days before them.
    """
    first = (F.floor(F.col("trade_index") / step) + 1) * step
    last = F.col("trade_index") + window
    seen = F.when(first <= last, F.sequence(first, last.cast("long"), F.lit(step).cast("long")))
    days = returns.where(F.col("trade_index") % step == 0).select(F.col("trade_index").cast("long").alias("rebalance")).distinct()
    return returns.withColumn("rebalance", F.explode(seen)).join(days, "rebalance")


def optimised_weights(rows: DataFrame, methods: Sequence[str] = METHODS, least: int = 20, cap: float = 0.6, risk_free: float = 0.02) -> DataFrame:
    """(portfolio, rebalance, symbol, method, weight), long only, no weight above cap (HRP: no cap).

    rows(portfolio, rebalance, symbol, trade_index, ret) are the returns a rebalance sees. An asset with fewer than
    ``least`` of them is left out; a day on which another asset doesn't trade is a return of 0. Without variance all
    weights are equal. A group is one rebalance of one portfolio, MOST_ASSETS assets at most.
    """

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        wide = f.pivot_table(index="trade_index", columns="symbol", values="ret").sort_index(axis=1)
        wide = wide.loc[:, wide.count() >= least]
        if wide.shape[1] > MOST_ASSETS:
            raise ValueError(f"portfolio {key[0]} has {wide.shape[1]} assets, more than {MOST_ASSETS}")
        parts = [pd.DataFrame({"symbol": wide.columns.to_numpy(dtype="int64"), "method": m, "weight": weights(wide.fillna(0.0).to_numpy(), m, cap, risk_free)}) for m in methods if wide.shape[1]]
        none = pd.DataFrame({"symbol": np.zeros(0, "int64"), "method": np.zeros(0, object), "weight": np.zeros(0)})
        out = pd.concat(parts) if parts else none
        return out.assign(portfolio=key[0], rebalance=key[1])[["portfolio", "rebalance", "symbol", "method", "weight"]]

    given = rows.where("ret IS NOT NULL").select(F.col("portfolio").cast("long"), F.col("rebalance").cast("long"), F.col("symbol").cast("long"), "trade_index", F.col("ret").cast("double"))
    # few bytes, much work: as many tasks as keep every core busy, which sizes alone would not give
    spread = given.repartition(4 * given.sparkSession.sparkContext.defaultParallelism, "portfolio", "rebalance")
    return spread.groupBy("portfolio", "rebalance").applyInPandas(solve, "portfolio long, rebalance long, symbol long, method string, weight double")


def weights(returns: np.ndarray, method: str, cap: float = 0.6, risk_free: float = 0.02) -> np.ndarray:
    """The weights of the columns of returns (days x assets) by one of METHODS."""
    n = returns.shape[1]
    equal = np.full(n, 1.0 / n)
    if n == 1 or len(returns) < 2:
        return equal
    cov = np.cov(returns.T) * 252
    if not np.trace(cov) > 1e-15:
        return equal
    if method == "HRP":
        return risk_parity(returns, cov)
    cap = max(cap, 1.0 / n)
    if method == "MIN_VARIANCE":

        def variance(w: np.ndarray) -> tuple[float, np.ndarray]:
            v = cov @ w
            return w @ v, 2 * v

        return _descend(variance, equal, cap)
    excess = returns.mean(axis=0) * 252 - risk_free

    def sharpe(w: np.ndarray) -> tuple[float, np.ndarray]:
        v = cov @ w
        gain, risk = excess @ w, math.sqrt(max(w @ v, 1e-16))
        return -gain / risk, gain * v / risk**3 - excess / risk

    return _descend(sharpe, equal, cap)


def _descend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, cap: float, rounds: int = 400) -> np.ndarray:
    """Projected descent whose step halves until the value falls; value(w) gives value and gradient."""
    now, slope = value(w)
    step = 1.0 / max(np.linalg.norm(slope), 1e-12)
    for _ in range(rounds):
        while step > 1e-14:
            new = nearest(w - step * slope, cap)
            then, its = value(new)
            far = new - w
            if then <= now - 1e-4 / step * (far @ far):
                break
            step /= 2
        else:
            break
        moved, w, now, slope = np.abs(new - w).max(), new, then, its
        if moved < 1e-8:
            break
        step *= 2
    return w


def nearest(w: np.ndarray, cap: float) -> np.ndarray:
    """The point of {0 <= x <= cap, sum(x) = 1} nearest to w: all of w less one shift, clipped.

    The clipped sum is linear between the shifts at which an entry leaves 0 or reaches cap, so one sort finds the shift.
    """
    n = len(w)
    ends = np.concatenate([w, w - cap])
    order = np.argsort(-ends)
    ends = ends[order]
    slope = np.cumsum(np.where(order < n, 1.0, -1.0))
    sums = np.concatenate([[0.0], np.cumsum(slope[:-1] * (ends[:-1] - ends[1:]))])
    k = int(np.searchsorted(sums, 1.0))
    shift = ends[-1] if k == len(sums) else ends[k - 1] - (1.0 - sums[k - 1]) / slope[k - 1]
    return np.minimum(np.maximum(w - shift, 0.0), cap)


def risk_parity(returns: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Weights split by inverse risk down the halves of assets ordered by single linkage of sqrt((1 - correlation) / 2)."""
    sd = np.sqrt(np.diag(cov))
    scale = np.outer(sd, sd)
    corr = np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0)
    order = _linked(np.sqrt(np.maximum(0.0, (1 - corr) / 2)))
    out = np.ones(len(cov))

    def risk(part: list[int]) -> float:
        own = cov[np.ix_(part, part)]
        inverse = np.linalg.pinv(own).sum(axis=1)
        share = inverse / inverse.sum() if abs(inverse.sum()) > 1e-12 else np.full(len(part), 1.0 / len(part))
        return float(share @ own @ share)

    def split(part: list[int]) -> None:
        if len(part) < 2:
            return
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = risk(left), risk(right)
        first = 1 - a / (a + b) if a + b > 0 else 0.5
        out[left] *= first
        out[right] *= 1 - first
        split(left)
        split(right)

    split(order)
    return out


def _linked(distance: np.ndarray) -> list[int]:
    """Order of leaves after joining the two nearest clusters again and again; ties to the first pair."""
    groups = {i: [i] for i in range(len(distance))}
    d = distance + np.diag(np.full(len(distance), np.inf))
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        groups[i] += groups.pop(j)
        d[i] = d[:, i] = np.minimum(d[i], d[j])
        d[i, i] = d[j] = d[:, j] = np.inf
    return next(iter(groups.values()))
