"""Market scans: anomalies and risks of each row, a score of nine components, and cards of the core, near and control layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import filters
from asoflab.functions.columns import ratio

#: What counts as an anomaly.
THRESHOLDS = {
    "price_surge": 0.05, "price_drop": -0.05, "volume_spike": 2.0, "amount_spike": 2.0, "high_turnover": 0.10, "volatility_spike": 0.60, "gap": 0.03,
    "limit_tolerance": 0.005, "liquidity_drop": 0.50, "low_amount": 20_000_000.0, "confluence": 3,
}

#: Weights of the components, and the largest penalty that risks take off.
WEIGHTS = {
    "query_match": 0.20, "anomaly_strength": 0.20, "technical": 0.15, "capital_flow": 0.15, "shadow_composite": 0.05,
    "factor_coverage": 0.10, "confidence": 0.05, "liquidity": 0.07, "freshness": 0.03,
}
MOST_PENALTY = 0.25


def with_anomalies(rows: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """rows with anomalies and risks, arrays in the order of the rules.

    rows(change, volume_ratio, amount_ratio, turnover_rate, volatility, gap, amount, price_volume_state, breakout, breakdown,
    limit_rate, previous_close, close, suspended); a NULL says nothing. Suspended rows have no anomalies.
    """
    t = thresholds
    tell = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    moved = F.col("close") / F.when(F.col("previous_close") > 0, F.col("previous_close")) - 1
    up, down = F.abs(moved - F.col("limit_rate")) <= t["limit_tolerance"], F.abs(moved + F.col("limit_rate")) <= t["limit_tolerance"]
    state = F.when(F.col("price_volume_state").isin("PRICE_UP_VOLUME_UP", "PRICE_UP_VOLUME_DOWN", "PRICE_DOWN_VOLUME_UP", "PRICE_DOWN_VOLUME_DOWN"), F.col("price_volume_state"))
    found = F.array_compact(F.array(
        tell(F.col("change") >= t["price_surge"], "PRICE_SURGE"), tell(F.col("change") <= t["price_drop"], "PRICE_DROP"), tell(F.col("volume_ratio") >= t["volume_spike"], "VOLUME_SPIKE"),
        tell(F.col("amount_ratio") >= t["amount_spike"], "AMOUNT_SPIKE"), tell(F.col("amount_ratio") <= t["liquidity_drop"], "LIQUIDITY_DROP"), tell(F.col("turnover_rate") >= t["high_turnover"], "HIGH_TURNOVER"), state,
        tell(F.col("breakout"), "BREAKOUT_HIGH"), tell(F.col("breakdown"), "BREAKDOWN_LOW"), tell(F.col("volatility") >= t["volatility_spike"], "VOLATILITY_SPIKE"), tell(F.col("gap") >= t["gap"], "GAP_UP"), tell(F.col("gap") <= -t["gap"], "GAP_DOWN"),
        tell(up, "PRICE_LIMIT_UP"), tell(~up & down, "PRICE_LIMIT_DOWN"),
    ))
    rows = rows.withColumn("_found", F.when(F.col("suspended"), F.array().cast("array<string>")).otherwise(found))
    many = F.size("_found") >= t["confluence"]
    risks = F.array_compact(F.array(
        tell(F.col("amount") < t["low_amount"], "LOW_LIQUIDITY"), tell(F.col("volatility") >= t["volatility_spike"], "EXTREME_VOLATILITY"), tell(F.col("limit_rate").isNull(), "PRICE_LIMIT_RULE_UNKNOWN"), tell(many, "MULTI_SIGNAL_CONFLUENCE"),
    ))
    gone = F.array(F.lit("POSSIBLE_SUSPENSION"), F.lit("SCANNER_DATA_GAP"))
    named = F.when(many, F.concat("_found", F.array(F.lit("MULTI_SIGNAL_CONFLUENCE")))).otherwise(F.col("_found"))
    return rows.withColumns({"anomalies": named, "risks": F.when(F.col("suspended"), gone).otherwise(risks)}).drop("_found")


def score_components() -> dict[str, Column]:
    """The nine components and the penalty, each in [0, 1]; scores in [-1, 1] are moved there, and count nothing where they are missing."""
    unit = lambda c: F.coalesce((F.col(c) + 1) / 2, F.lit(0.0))
    return {
        "query_match": F.lit(1.0), "anomaly_strength": F.least(F.lit(1.0), F.size("anomalies") / 4), "technical": unit("technical_score"), "capital_flow": unit("capital_score"), "shadow_composite": unit("shadow_score"),
        "factor_coverage": F.col("coverage").cast("double"), "confidence": F.coalesce(F.col("composite_confidence").cast("double"), F.lit(0.0)), "liquidity": F.coalesce(F.col("amount_percentile").cast("double"), F.lit(0.0)), "freshness": F.when(F.col("stale"), 0.5).otherwise(1.0),
        "penalty": F.least(F.lit(MOST_PENALTY), F.size("risks") * 0.05),
    }


def with_score(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """rows with components (a struct) and scanner_score in [0, 1]."""
    parts = score_components()
    total = -parts["penalty"]
    for name, w in weights.items():
        total = total + parts[name] * w
    return rows.withColumn("components", F.struct(*[v.alias(k) for k, v in parts.items()])).withColumn("scanner_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def scan(features: DataFrame, plan: filters.Node, top: int, required: Sequence[str] = (), order: Sequence[Column] = (), scope: Column | None = None) -> DataFrame:
    """Cards of each trade_date: (trade_date, symbol, layer, place, scanner_score, components, anomalies, risks).

    The scope's rows fall into CORE (plan holds), NEAR (one condition is nearly met) and CONTROL. Core rows need the
    ``required`` anomalies. CORE and NEAR are ordered by ``order``, then score, then symbol; CONTROL by amount. The best
    ``top`` of each layer are told. One shuffle by date and layer, in which only the first rows of each are kept.
    """
    rows = filters.layered(features if scope is None else features.where(scope), plan)
    rows = with_score(with_anomalies(rows))
    has = F.size(F.array_except(F.array(*map(F.lit, required)), "anomalies")) == 0 if required else F.lit(True)
    rows = rows.where((F.col("layer") != "CORE") | has).withColumn("scanner_score", F.round("scanner_score", 9))
    first = F.when(F.col("layer") == "CONTROL", F.col("amount")).otherwise(F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("trade_date", "layer").orderBy(F.desc_nulls_last(first), *order, F.desc("scanner_score"), "symbol"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("trade_date", "symbol", "layer", "place", "scanner_score", "components", "anomalies", "risks")


def missing_and_matched(features: DataFrame, plan: filters.Node) -> DataFrame:
    """By trade_date: rows of the universe, matches, near misses, and rows that lack a field of the plan."""
    match, missing = filters.compiled(plan)
    return features.groupBy("trade_date").agg(F.count("*").alias("universe"), F.count_if(match).alias("matched"), F.count_if(~match & filters.near_miss(plan)).alias("near"), F.count_if(missing).alias("lacking"), ratio(F.count_if(match).cast("double"), F.count("*")).alias("share"))
