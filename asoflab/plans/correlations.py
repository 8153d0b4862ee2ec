"""Queries of the correlation matrix of 38 features and the families that it makes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflab.operators import moments as M
from asoflab.plans.features import r
from asoflab.plans.registry import query
from asoflab.sources import shared
from asoflab.sources import views as V


def _features() -> dict[str, tuple[str, str]]:
    """feature -> (semantic family, expression over a symbol's ordered bars); w is the symbol's window."""
    past = lambda n: "OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)".format(n - 1)
    w = "OVER (PARTITION BY symbol ORDER BY trade_date)"
    out = {f"ret_{n}": ("PRICE_REACTION", f"close / nullif(lag(close, {n}) {w}, 0) - 1") for n in (1, 2, 3, 5, 10, 20, 60)}
    out |= {f"gap_{n}": ("PRICE_REACTION", f"open / nullif(lag(close, {n}) {w}, 0) - 1") for n in (1, 2, 3)}
    out |= {"intraday": ("PRICE_REACTION", "close / nullif(open, 0) - 1"), "amplitude": ("PRICE_REACTION", "(high - low) / nullif(open, 0)"), "location": ("PRICE_REACTION", "(close - low) / nullif(high - low, 0)")}
    out |= {f"sma_{n}": ("TREND", f"close / nullif(avg(close) {past(n)}, 0) - 1") for n in (3, 5, 10, 20, 60)}
    out |= {f"high_{n}": ("TREND", f"close / nullif(max(high) {past(n)}, 0) - 1") for n in (5, 20, 60)}
    out |= {f"low_{n}": ("TREND", f"close / nullif(min(low) {past(n)}, 0) - 1") for n in (5, 20, 60)}
    out |= {f"volume_{n}": ("LIQUIDITY", f"volume / nullif(avg(volume) {past(n)}, 0)") for n in (2, 5, 20, 60)}
    out |= {f"amount_{n}": ("LIQUIDITY", f"amount / nullif(avg(amount) {past(n)}, 0)") for n in (2, 5, 20, 60)}
    out |= {"volume": ("LIQUIDITY", "volume"), "amount": ("LIQUIDITY", "amount"), "unit": ("LIQUIDITY", "amount / nullif(volume, 0)")}
    out |= {f"range_{n}": ("RISK", f"(max(high) {past(n)} - min(low) {past(n)}) / nullif(close, 0)") for n in (5, 20, 60)}
    return out


FEATURES = _features()
NAMES = list(FEATURES)

_LONG = ", ".join(f"{{'c': '{n}', 'k': {k}, 'v': {n}}}" for k, n in enumerate(NAMES))
CORRELATED_SQL = f"""{V.ctes('bars_c')}, features AS (SELECT row_number() OVER () AS row, {', '.join(f'round({e}, 6) AS {n}' for n, (_, e) in FEATURES.items())} FROM bars_c),
long AS (SELECT row, z.c AS c, z.k AS k, z.v AS v FROM (SELECT row, unnest([{_LONG}]) AS z FROM features) WHERE z.v IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2.0 AS rv FROM long),
pairs AS (SELECT x.c AS a, y.c AS b, count(*) AS n, CASE WHEN count(*) >= 20 THEN covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0) END AS pearson, CASE WHEN count(*) >= 20 THEN covar_pop(x.rv, y.rv) / nullif(stddev_pop(x.rv) * stddev_pop(y.rv), 0) END AS spearman FROM ranked x JOIN ranked y ON x.row = y.row AND x.k < y.k GROUP BY 1, 2)"""


def made(bars: Mapping[str, np.ndarray]) -> list[np.ndarray]:
    """FEATURES, rounded, of bars(symbol, open, close, high, low, volume, amount), symbols together and in order of time."""
    s, n = bars["symbol"], len(bars["symbol"])
    same = np.r_[False, (s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))] if n else np.zeros(0, bool)
    rows = np.arange(n)
    place = rows - np.maximum.accumulate(np.where(same, 0, rows)) if n else rows

    def lag(x: np.ndarray, k: int) -> np.ndarray:
        return np.where(place >= k, np.r_[np.full(min(k, n), np.nan), x[: max(n - k, 0)]], np.nan)

    def past(x: np.ndarray, widths: Sequence[int], merge: np.ufunc) -> dict[int, np.ndarray]:
        """The merge of the last rows of each width, x among them."""
        out, own, early = {}, x.copy(), np.flatnonzero(place < max(widths))
        for k in range(max(widths)):
            if 0 < k < n:
                alone = early[place[early] < k]  # what is k rows before is another symbol's
                kept = own[alone]
                merge(own[k:], x[:-k], out=own[k:])
                own[alone] = kept
            if k + 1 in widths:
                out[k + 1] = own.copy()
        return out

    def mean(x: np.ndarray, widths: Sequence[int]) -> dict[int, np.ndarray]:
        none = np.isnan(x)
        counts = past(np.where(none, 0.0, 1.0), widths, np.add) if none.any() else {k: np.minimum(place + 1.0, k) for k in widths}
        return {k: over(v, counts[k]) for k, v in past(np.where(none, 0.0, x), widths, np.add).items()}

    over = lambda a, b: a / np.where(b == 0, np.nan, b)
    open_, close, high, low, volume, amount = (bars[c] for c in ("open", "close", "high", "low", "volume", "amount"))
    top, bottom, averages = past(high, (5, 20, 60), np.fmax), past(low, (5, 20, 60), np.fmin), mean(close, (3, 5, 10, 20, 60))
    out = {f"ret_{k}": over(close, lag(close, k)) - 1 for k in (1, 2, 3, 5, 10, 20, 60)} | {f"gap_{k}": over(open_, lag(close, k)) - 1 for k in (1, 2, 3)}
    out |= {"intraday": over(close, open_) - 1, "amplitude": over(high - low, open_), "location": over(close - low, high - low)}
    out |= {f"sma_{k}": over(close, v) - 1 for k, v in averages.items()}
    out |= {f"high_{k}": over(close, v) - 1 for k, v in top.items()} | {f"low_{k}": over(close, v) - 1 for k, v in bottom.items()}
    out |= {f"{name}_{k}": over(x, v) for name, x in (("volume", volume), ("amount", amount)) for k, v in mean(x, (2, 5, 20, 60)).items()}
    out |= {"volume": volume, "amount": amount, "unit": over(amount, volume)} | {f"range_{k}": over(v - bottom[k], close) for k, v in top.items()}
    return [rounded(out[name]) for name in NAMES]


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    y = np.abs(x) * 1e6
    return np.where(y < 2**52, np.copysign(np.floor(y + 0.5), x) / 1e6, x) + 0.0


def correlated(spark, sf) -> DataFrame:
    bars = V.bars_c(spark, sf, together=True).sortWithinPartitions("symbol", "trade_date")
    return M.all_correlations(bars.select("symbol", "open", "close", "high", "low", "volume", "amount"), NAMES, made=made, key="symbol")


@query("AGG_31_matrix_of_features", f"{CORRELATED_SQL} SELECT a, b, n, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman FROM pairs")
def matrix_of_features(spark, sf):
    return r(correlated(spark, sf), ["a", "b", "n"], 5, pearson=F.col("pearson"), spearman=F.col("spearman"))


@query("DOM_23_families_of_features", f"""WITH RECURSIVE {CORRELATED_SQL.removeprefix('WITH ')}, edges AS (SELECT a, b FROM pairs WHERE abs(pearson) > 0.8 OR abs(spearman) > 0.8), linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reached AS (SELECT a, a AS b FROM linked UNION SELECT r.a, e.b FROM reached r JOIN linked e ON r.b = e.a)
SELECT 'CORRELATION' AS family_type, min(b) AS family, a AS feature FROM reached GROUP BY a UNION ALL SELECT * FROM (VALUES {', '.join(f"('SEMANTIC', '{s}', '{n}')" for n, (s, _) in FEATURES.items())}) t""")
def families_of_features(spark, sf):
    shared.checkpoint_dir(spark)
    pairs = correlated(spark, sf).checkpoint()  # a row for each pair of features, read twice
    named = spark.createDataFrame([(n, s) for n, (s, _) in FEATURES.items()], "feature string, semantic string")
    return M.feature_families(pairs, named)
