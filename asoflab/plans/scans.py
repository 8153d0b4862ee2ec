"""Queries of whole-market scans on every day: nine components, anomalies, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.functions import filters
from asoflab.functions.filters import Node
from asoflab.operators import pit
from asoflab.operators import scan as S
from asoflab.plans.registry import query
from asoflab.sources import views as V

#: A rise of at least 0.5 % on at least the usual volume, or a new high, away from calm.
PLAN = Node("AND", children=[Node("OR", children=[Node("GTE", "change_percent", 0.5), Node("EQ", "breakout_n", 1)]), Node("GTE", "volume_ratio", 1.0), Node("RANGE", "volatility", (0.1, 1.5))])
TOP = 3

FEATURES_SQL = f"""{V.ctes('bars_c', 'days_c')}, path AS (SELECT *, lag(close) OVER w AS pc, lag(trade_index) OVER w AS pi FROM (SELECT * FROM bars_c JOIN days_c USING (trade_date)) WINDOW w AS (PARTITION BY symbol ORDER BY trade_index)),
moved AS (SELECT *, close / nullif(pc, 0) - 1 AS ret, ln(nullif(close / nullif(pc, 0), 0)) AS lr FROM path),
wide AS (SELECT *, avg(volume) OVER before AS v5, avg(amount) OVER before AS a5, count(*) OVER before AS n5, stddev_samp(lr) OVER recent AS sd, count(lr) OVER recent AS nsd, max(high) OVER prior AS top, min(low) OVER prior AS bottom, count(*) OVER prior AS np,
  avg(close) OVER recent AS m20, count(*) OVER recent AS n20, rank() OVER (PARTITION BY trade_date ORDER BY amount) / (count(*) OVER (PARTITION BY trade_date))::DOUBLE AS amount_percentile FROM moved
  WINDOW before AS (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), recent AS (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), prior AS (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
features AS (SELECT symbol, trade_date, close, pc AS previous_close, amount, round(100 * ret, 6) AS change_percent, round(ret, 9) AS change, round(CASE WHEN n5 = 5 THEN volume / nullif(v5, 0) END, 9) AS volume_ratio, round(CASE WHEN n5 = 5 THEN amount / nullif(a5, 0) END, 9) AS amount_ratio, round(CASE WHEN nsd = 20 THEN sd * sqrt(252) END, 9) AS volatility,
  round(open / nullif(pc, 0) - 1, 9) AS gap, CASE WHEN np = 20 THEN close > top END AS breakout, CASE WHEN np = 20 THEN close < bottom END AS breakdown, CASE WHEN symbol % 11 <> 10 THEN 0.05 * (1 + symbol % 3) END AS limit_rate, trade_index - pi > 2 AS stale,
  CASE WHEN n20 = 20 THEN least(1, greatest(-1, (close / nullif(m20, 0) - 1) * 12)) END AS tech, amount_percentile FROM wide),
ready AS (SELECT *, round(volume_ratio / 40, 9) AS turnover_rate, CASE WHEN change IS NOT NULL AND volume_ratio IS NOT NULL THEN CASE WHEN change >= 0.01 THEN 'PRICE_UP' WHEN change <= -0.01 THEN 'PRICE_DOWN' ELSE 'PRICE_FLAT' END || CASE WHEN volume_ratio >= 1.2 THEN '_VOLUME_UP' WHEN volume_ratio <= 0.8 THEN '_VOLUME_DOWN' ELSE '_VOLUME_FLAT' END END AS state,
  CASE WHEN amount_ratio > 0 THEN least(1, greatest(-1, log2(amount_ratio) / 2)) END AS capital, (tech IS NOT NULL)::INT + (amount_ratio IS NOT NULL)::INT + (volatility IS NOT NULL)::INT + (gap IS NOT NULL)::INT + (breakout IS NOT NULL)::INT AS seen FROM features)"""

_PASS = "((coalesce(change_percent >= 0.5, false) OR coalesce(breakout::INT = 1, false)) AND coalesce(volume_ratio >= 1.0, false) AND coalesce(volatility BETWEEN 0.1 AND 1.5, false))"
_OR = "(coalesce(change_percent >= 0.5, false) OR coalesce(breakout::INT = 1, false))"
_NEAR_OR = f"((coalesce(abs(change_percent - 0.5) <= 0.1, false) AND NOT coalesce(change_percent >= 0.5, false) OR coalesce(abs(breakout::INT - 1) <= 0.1, false) AND NOT coalesce(breakout::INT = 1, false)) AND NOT {_OR})"
_NEAR_VOLUME = "(coalesce(abs(volume_ratio - 1.0) <= 0.1, false) AND NOT coalesce(volume_ratio >= 1.0, false))"
_NEAR_RISK = "(coalesce(volatility >= 0.1 - 0.1 * (1.5 - 0.1) AND volatility <= 1.5 + 0.1 * (1.5 - 0.1), false) AND NOT coalesce(volatility BETWEEN 0.1 AND 1.5, false))"
_V, _R = "coalesce(volume_ratio >= 1.0, false)", "coalesce(volatility BETWEEN 0.1 AND 1.5, false)"
_ALMOST = f"({_NEAR_OR} AND {_V} AND {_R} OR {_OR} AND {_NEAR_VOLUME} AND {_R} OR {_OR} AND {_V} AND {_NEAR_RISK})"
_UP = "coalesce(abs(close / CASE WHEN previous_close > 0 THEN previous_close END - 1 - limit_rate) <= 0.005, false)"
_DOWN = "coalesce(abs(close / CASE WHEN previous_close > 0 THEN previous_close END - 1 + limit_rate) <= 0.005, false)"
_RULES = [
    ("change >= 0.05", "PRICE_SURGE"), ("change <= -0.05", "PRICE_DROP"), ("volume_ratio >= 2", "VOLUME_SPIKE"), ("amount_ratio >= 2", "AMOUNT_SPIKE"), ("amount_ratio <= 0.5", "LIQUIDITY_DROP"), ("turnover_rate >= 0.1", "HIGH_TURNOVER"), (None, "state"),
    ("breakout", "BREAKOUT_HIGH"), ("breakdown", "BREAKDOWN_LOW"), ("volatility >= 0.6", "VOLATILITY_SPIKE"), ("gap >= 0.03", "GAP_UP"), ("gap <= -0.03", "GAP_DOWN"), (_UP, "PRICE_LIMIT_UP"), (f"NOT {_UP} AND {_DOWN}", "PRICE_LIMIT_DOWN"),
]
_FOUND = ", ".join("CASE WHEN state NOT LIKE '%FLAT%' THEN state END" if c is None else f"CASE WHEN {c} THEN '{n}' END" for c, n in _RULES)
SCAN_SQL = f"""{FEATURES_SQL}, layered AS (SELECT *, CASE WHEN {_PASS} THEN 'CORE' WHEN {_ALMOST} THEN 'NEAR' ELSE 'CONTROL' END AS layer, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS found FROM ready),
flagged AS (SELECT *, CASE WHEN len(found) >= 3 THEN list_append(found, 'MULTI_SIGNAL_CONFLUENCE') ELSE found END AS anomalies, list_filter([CASE WHEN amount < 20000000 THEN 'LOW_LIQUIDITY' END, CASE WHEN volatility >= 0.6 THEN 'EXTREME_VOLATILITY' END, CASE WHEN limit_rate IS NULL THEN 'PRICE_LIMIT_RULE_UNKNOWN' END, CASE WHEN len(found) >= 3 THEN 'MULTI_SIGNAL_CONFLUENCE' END], lambda x: x IS NOT NULL) AS risks FROM layered),
scored AS (SELECT *, round(greatest(0, least(1, 0.2 + 0.2 * least(1, len(anomalies) / 4) + 0.15 * coalesce((tech + 1) / 2, 0) + 0.15 * coalesce((capital + 1) / 2, 0) + 0.05 * coalesce(((tech + capital) / 2 + 1) / 2, 0) + 0.1 * seen / 5.0 + 0.05 * seen / 5.0 + 0.07 * amount_percentile + 0.03 * CASE WHEN stale THEN 0.5 ELSE 1 END - least(0.25, 0.05 * len(risks)))), 9) AS score FROM flagged)"""


def scan_features(spark, sf) -> DataFrame:
    """What a scan reads of each bar: ratios to the five bars before, volatility, gap, breakouts, limits, scores and coverage."""
    bars = pit.with_trade_index(V.bars_c(spark, sf), pit.trading_days(V.dates_a(spark, sf)))
    by = Window.partitionBy("symbol").orderBy("trade_index")
    before, recent, prior = by.rowsBetween(-5, -1), by.rowsBetween(-19, 0), by.rowsBetween(-20, -1)
    path = bars.withColumns({"previous_close": F.lag("close").over(by), "last_index": F.lag("trade_index").over(by)})
    path = path.withColumn("lr", F.log(F.nullif(C.ratio("close", "previous_close"), F.lit(0.0))))
    full = lambda value, frame, n: F.when(F.count(F.lit(1)).over(frame) == n, value)
    day = Window.partitionBy("trade_date")
    f = path.select(
        "symbol", "trade_date", "close", "previous_close", "amount", F.round(100 * (C.ratio("close", "previous_close") - 1), 6).alias("change_percent"), F.round(C.ratio("close", "previous_close") - 1, 9).alias("change"),
        F.round(full(C.ratio("volume", F.avg("volume").over(before)), before, 5), 9).alias("volume_ratio"), F.round(full(C.ratio("amount", F.avg("amount").over(before)), before, 5), 9).alias("amount_ratio"),
        F.round(F.when(F.count("lr").over(recent) == 20, F.stddev_samp("lr").over(recent) * F.sqrt(F.lit(252.0))), 9).alias("volatility"), F.round(C.ratio("open", "previous_close") - 1, 9).alias("gap"),
        full(F.col("close") > F.max("high").over(prior), prior, 20).alias("breakout"), full(F.col("close") < F.min("low").over(prior), prior, 20).alias("breakdown"), F.when(F.col("symbol") % 11 != 10, 0.05 * (1 + F.col("symbol") % 3)).alias("limit_rate"),
        (F.col("trade_index") - F.col("last_index") > 2).alias("stale"), C.clip(full((C.ratio("close", F.avg("close").over(recent)) - 1) * 12, recent, 20)).alias("technical_score"), (F.rank().over(day.orderBy("amount")) / F.count("*").over(day)).alias("amount_percentile"),
    )
    price = F.when(F.col("change") >= 0.01, "PRICE_UP").when(F.col("change") <= -0.01, "PRICE_DOWN").otherwise("PRICE_FLAT")
    volume = F.when(F.col("volume_ratio") >= 1.2, "_VOLUME_UP").when(F.col("volume_ratio") <= 0.8, "_VOLUME_DOWN").otherwise("_VOLUME_FLAT")
    f = f.withColumns({
        "turnover_rate": F.round(F.col("volume_ratio") / 40, 9), "price_volume_state": F.when(F.col("change").isNotNull() & F.col("volume_ratio").isNotNull(), F.concat(price, volume)), "capital_score": F.when(F.col("amount_ratio") > 0, C.clip(F.log2("amount_ratio") / 2)),
        "coverage": sum((F.col(c).isNotNull().cast("int") for c in ("technical_score", "amount_ratio", "volatility", "gap", "breakout")), F.lit(0)) / 5.0, "suspended": F.lit(False), "breakout_n": F.col("breakout").cast("int"),
    })
    return f.withColumns({"shadow_score": (F.col("technical_score") + F.col("capital_score")) / 2, "composite_confidence": F.col("coverage")})


@query("DOM_3_SRT_2_scan_cards", f"""{SCAN_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY trade_date, layer ORDER BY CASE WHEN layer = 'CONTROL' THEN amount ELSE 0 END DESC, score DESC, symbol) AS place FROM scored WHERE layer <> 'CORE' OR list_contains(anomalies, 'PRICE_UP_VOLUME_UP'))
SELECT trade_date, symbol, layer, place, score, array_to_string(anomalies, ',') AS anomalies, array_to_string(risks, ',') AS risks FROM placed WHERE place <= {TOP}""")
def scan_cards(spark, sf):
    cards = S.scan(scan_features(spark, sf), PLAN, TOP, required=["PRICE_UP_VOLUME_UP"])
    return cards.select("trade_date", "symbol", "layer", F.col("place").cast("long").alias("place"), F.col("scanner_score").alias("score"), F.array_join("anomalies", ",").alias("anomalies"), F.array_join("risks", ",").alias("risks"))


@query("SRT_2_scanner_scores", f"""{SCAN_SQL} SELECT symbol, trade_date, layer, score, len(anomalies) AS n_anomalies, len(risks) AS n_risks FROM scored""")
def scanner_scores(spark, sf):
    rows = S.with_score(S.with_anomalies(filters.layered(scan_features(spark, sf), PLAN)))
    return rows.select("symbol", "trade_date", "layer", F.round("scanner_score", 9).alias("score"), F.size("anomalies").cast("long").alias("n_anomalies"), F.size("risks").cast("long").alias("n_risks"))


@query("DOM_3_scan_summary", f"""{SCAN_SQL} SELECT trade_date, count(*) AS universe, count(*) FILTER (layer = 'CORE') AS matched, count(*) FILTER (layer = 'NEAR') AS near, round(avg((layer = 'CORE')::INT), 6) AS share FROM layered GROUP BY 1""")
def scan_summary(spark, sf):
    s = S.missing_and_matched(scan_features(spark, sf), PLAN)
    return s.select("trade_date", "universe", "matched", "near", F.round("share", 6).alias("share"))
