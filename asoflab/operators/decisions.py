"""Decision tables over candidates and dates: price zones, action, target size and execution status of each row; risk checks of portfolios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Action names, reason codes, statuses, sizes and policy limits below are part of the results.
ENTRIES = ("STRONG_BUY", "BUY", "SMALL_BUY")
EXITS = ("REDUCE", "EXIT", "STOP_LOSS")
STATUS = {"now": "立即执行", "confirm": "等待确认", "pullback": "等待回调", "floor": "等待止跌确认", "chase": "禁止追高", "broken": "信号失效", "void": "已失效"}
WAIT_MIN, REDUCE_MIN, STOP_LOSS_BELOW, REMINDER = -0.20, -0.50, -0.15, 0.15


@dataclass(frozen=True)
class Limits:
    """Of one position (single, risky, sector), and of a portfolio's risk checks."""

    single: float = 0.20
    risky: float = 0.05
    sector: float = 0.35
    asset: float = 0.60
    history: int = 250
    liquidity: float = 2e7
    total: float = 1.0
    equity: float = 0.50
    drawdown: float = 0.20
    volatility: float = 0.25
    stress: float = 0.15


def with_levels(bars: DataFrame, ranges: int = 14, lookback: int = 20) -> DataFrame:
    """bars(symbol, trade_date, high, low, close) with atr (mean of the true ranges there are, 0 without any), support and resistance."""
    by = Window.partitionBy("symbol").orderBy("trade_date")
    before = F.lag("close").over(by)
    span = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    near = by.rowsBetween(1 - lookback, 0)
    rows = bars.withColumn("_range", span).withColumns({"atr": F.coalesce(F.avg("_range").over(by.rowsBetween(1 - ranges, 0)), F.lit(0.0)), "support": F.min("low").over(near), "resistance": F.max("high").over(near)})
    return rows.drop("_range")


def with_thresholds(rows: DataFrame, score: str = "score") -> DataFrame:
    """rows with strong_min and buy_min, the 90th and 75th percentile of the score on their date: a row a day, counted by dates alone."""
    days = rows.groupBy("trade_date").agg(F.percentile(score, F.array(F.lit(0.9), F.lit(0.75))).alias("_q"))
    return rows.join(days.select("trade_date", F.round(F.col("_q")[0], 9).alias("strong_min"), F.round(F.col("_q")[1], 9).alias("buy_min")), "trade_date")


def _first(*rules: tuple[Column, str], last: str) -> Column:
    """The value of the first rule that holds; a NULL condition doesn't."""
    out = F
    for condition, value in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(value))
    return out.otherwise(F.lit(last))


def with_action(rows: DataFrame) -> DataFrame:
    """rows with action, reasons (in order of the rules), confidence and what the action allows.

    rows(score, strong_min, buy_min, technical, capital, confidence, data_status, point_in_time, veto, held, unrealized, reminder);
    veto is the kind of a hard objection or NULL, and goes before every score. data_status FAILED and STALE stop a row, and so does a
    row that isn't point in time. A reminder of risk weakens an entry to SMALL_BUY, and costs confidence.
    """
    s, held, veto = F.col("score"), F.coalesce(F.col("held"), F.lit(False)), F.col("veto").isNotNull()
    stopped = _first((F.col("data_status") == "FAILED", "DATA_FAILED_STOP_DECISION"), (F.col("data_status") == "STALE", "DATA_STALE_NO_BUY"), (~F.col("point_in_time"), "POINT_IN_TIME_FAILED"), last="")
    confirmed = (F.col("technical") > 0) & (F.col("capital") > 0)
    fresh = _first((s >= F.col("strong_min"), "SCORE_GE_STRONG_BUY_Q"), (s >= F.col("buy_min"), "SCORE_GE_BUY_Q"), (s >= WAIT_MIN, "SCORE_IN_WAIT_BAND"), last="SCORE_LT_WAIT_AVOID")
    kept = _first(
        ((s >= F.col("strong_min")) & confirmed, "SCORE_GE_STRONG_BUY_Q_TREND_CAPITAL_OK"), (s >= F.col("strong_min"), "SCORE_GE_STRONG_BUY_Q_NO_CONFIRM"), (s >= F.col("buy_min"), "SCORE_GE_BUY_Q_HOLD"),
        (s >= REDUCE_MIN, "SCORE_BELOW_WATCH_BAND_REDUCE"), (F.col("unrealized") < STOP_LOSS_BELOW, "SCORE_LT_EXIT_MAX_LOSS_STOP_LOSS"), last="SCORE_LT_EXIT_MAX_EXIT",
    )
    rows = rows.withColumns({"_stopped": stopped, "_why": F.when(held, kept).otherwise(fresh)})
    why = F.col("_why")
    plain = _first(
        (why == "SCORE_GE_STRONG_BUY_Q", "STRONG_BUY"), (why == "SCORE_GE_BUY_Q", "BUY"), (why == "SCORE_IN_WAIT_BAND", "WAIT"), (why == "SCORE_LT_WAIT_AVOID", "AVOID"), (why == "SCORE_GE_STRONG_BUY_Q_TREND_CAPITAL_OK", "ADD"),
        (why == "SCORE_BELOW_WATCH_BAND_REDUCE", "REDUCE"), (why == "SCORE_LT_EXIT_MAX_LOSS_STOP_LOSS", "STOP_LOSS"), (why == "SCORE_LT_EXIT_MAX_EXIT", "EXIT"), last="HOLD",
    )
    warned = F.coalesce(F.col("reminder"), F.lit(False))
    weaker = warned & plain.isin("STRONG_BUY", "BUY")
    free = F.col("_stopped") == ""
    action = F.when(~free, "WAIT").when(veto & held, "EXIT").when(veto, "AVOID").when(weaker, "SMALL_BUY").otherwise(plain)
    reasons = F.array_compact(F.array(
        F.when((F.col("data_status") == "DEGRADED"), "DATA_DEGRADED_REDUCE_POSITION"), F.when(~free, F.col("_stopped")), F.when(free & veto, F.concat(F.lit("VETO_"), "veto")), F.when(free & veto, F.when(held, "VETO_EXIT").otherwise("VETO_AVOID")),
        F.when(free & ~veto, why), F.when(free & ~veto & weaker, "SENTIMENT_V3_RISK_REMINDER_DOWNGRADE"), F.when(free & ~veto & warned, "SENTIMENT_V3_RISK_REMINDER_CONFIDENCE_PENALTY"),
    ))
    sure = F.when(free & ~veto & warned, F.greatest(F.lit(0.0), F.col("confidence") - REMINDER)).otherwise(F.col("confidence"))
    rows = rows.withColumns({"action": action, "reasons": reasons, "confidence": sure}).drop("_stopped", "_why")
    return rows.withColumns({"allow_new": F.col("action").isin(*ENTRIES), "allow_add": F.col("action") == "ADD", "recommend_reduce": F.col("action").isin(*EXITS) & ~veto, "recommend_exit": F.col("action").isin("EXIT", "STOP_LOSS")})


def with_zones(rows: DataFrame, digits: int = 2) -> DataFrame:
    """rows(action, close, atr, support, resistance) with entry, preferred, add, reduce and take-profit zones (low and high), stop and risk_reward.

    A zone that the action doesn't have is NULL, and all are where the close isn't positive. The stop is the lower of two ranges below the close and the support.
    """
    p, action, support, resistance = F.col("close"), F.col("action"), F.col("support"), F.col("resistance")
    stop = F.coalesce(F.least(F.when(F.col("atr") > 0, p - 2 * F.col("atr")), F.when(support > 0, support)), p * 0.92)
    rows = rows.withColumns({"_stop": stop, "_top": p * 1.01, "_low": F.when((support > 0) & (F.greatest(support, p * 0.95) <= p * 1.01), F.greatest(support, p * 0.95)).otherwise(p * 0.95)})
    rows = rows.withColumn("_goal", F.when(resistance > 0, F.greatest(resistance, F.col("_top") * 1.05)).otherwise(F.col("_top") * 1.08))
    entry, add, less = action.isin(*ENTRIES), action == "ADD", action.isin("REDUCE", "TAKE_PROFIT")
    low, top, goal = F.col("_low"), F.col("_top"), F.col("_goal")
    zones = {
        "entry_low": F.when(entry, low), "entry_high": F.when(entry, top), "preferred_high": F.when(entry & (top > low), low + 0.40 * (top - low)), "add_low": F.when(entry, top * 1.02).when(add, p * 0.97), "add_high": F.when(entry, top * 1.08).when(add, p * 1.02),
        "reduce_low": F.when(less, p * 0.98), "reduce_high": F.when(less, p * 1.05), "profit_low": F.when(entry, goal).when(add, resistance), "profit_high": F.when(entry, goal * 1.06).when(add, resistance * 1.05),
        "stop": F.when(entry | add | action.isin("HOLD", "WAIT", "AVOID"), F.col("_stop")),
    }
    rows = rows.withColumns({n: F.round(F.when(p > 0, z), digits) for n, z in zones.items()})
    fall = p - F.col("stop")
    return rows.withColumn("risk_reward", F.when(entry & (fall > 0), F.round((F.col("profit_high") - p) / fall, digits))).drop("_stop", "_top", "_low", "_goal")


def with_size(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """rows(action, score, strong_min, buy_min, data_status, veto, position, sector_position, cash, volatility, risky) with target, move, batches and allowed."""
    now, most = F.col("position"), F.when(F.col("risky"), min(limits.single, limits.risky)).otherwise(limits.single)
    action = F.col("action")
    base = (
        F.when(action == "STRONG_BUY", F.when(F.col("score") >= F.col("strong_min"), 0.18).otherwise(0.12)).when(action == "BUY", F.when(F.col("score") >= F.col("buy_min"), 0.12).otherwise(0.08)).when(action == "SMALL_BUY", 0.03)
        .when(action == "ADD", F.least(now + 0.05, F.lit(0.20))).when(action == "REDUCE", F.greatest(now - 0.05, F.lit(0.0))).when(action.isin("EXIT", "STOP_LOSS"), 0.0).otherwise(now)
    )
    cut = base * F.when(F.col("volatility") > 0.05, 0.8).otherwise(1.0) * F.when(F.col("data_status") == "DEGRADED", 0.5).otherwise(1.0)
    within = F.least(cut, F.greatest(F.lit(0.0), limits.sector - F.col("sector_position")), F.col("cash"), most)
    free = F.when(action.isin(*EXITS), F.least(within, now)).otherwise(within)
    still, veto = F.col("data_status").isin("STALE", "FAILED"), F.col("veto").isNotNull()
    rows = rows.withColumn("target", F.when(still, now).when(veto, F.least(now, most)).otherwise(F.round(free, 4)))
    rows = rows.withColumn("move", F.when(still | veto, 0.0).otherwise(F.round(free - now, 4)))
    size = F.abs("move")
    return rows.withColumns({"batches": F.when(size <= 0.001, 0).when(size <= 0.05, 1).when(size <= 0.10, 2).otherwise(3), "allowed": F.col("move") > 0.001})


def execution_status(price: Column) -> Column:
    """What to do at a later price about a decision whose zones and stop are frozen."""
    action, broken = F.col("action"), (F.col("stop") > 0) & (price <= F.col("stop"))
    entry = action.isin(*ENTRIES)
    return _first(
        (F.col("veto").isNotNull(), STATUS["void"]), (broken, STATUS["broken"]), (action == "AVOID", STATUS["void"]), (entry & F.col("entry_low").isNull(), STATUS["pullback"]),
        (entry & F.col("preferred_high").isNotNull() & (price < F.col("entry_low")), STATUS["floor"]), (entry & (price <= F.coalesce("preferred_high", "entry_high")), STATUS["now"]), (entry & (price <= F.col("entry_high")), STATUS["pullback"]),
        (entry, STATUS["chase"]), (action.isin("ADD", "TAKE_PROFIT", *EXITS), STATUS["now"]), last=STATUS["confirm"],
    )


def decision_table(rows: DataFrame, limits: Limits = Limits(), digits: int = 2) -> DataFrame:
    """Candidates of every date (columns of with_action, with_zones and with_size) decided at their close, and told at their symbol's next close."""
    decided = with_size(with_zones(with_action(rows), digits), limits)
    later = decided.withColumn("later", F.coalesce(F.lead("close").over(Window.partitionBy("symbol").orderBy("trade_date")), F.col("close")))
    return later.withColumn("status", execution_status(F.col("later")))


def risk_facts(positions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a portfolio: what the rules look at. positions(portfolio, symbol, weight, history, last, liquidity, equity boolean, shock, known boolean)."""
    w = F.col("weight")
    return positions.groupBy("portfolio").agg(
        F.count("*").alias("assets"), F.count_if(F.col("history") < limits.history).alias("shallow"), F.count_if(F.col("last").isNull()).alias("undated"), F.count_if(F.coalesce("history", F.lit(0)) == 0).alias("unseen"),
        F.count_if(w > limits.asset + 1e-9).alias("over"), F.count_if(F.col("liquidity") < limits.liquidity).alias("illiquid"), F.count_if(~F.coalesce(F.col("known"), F.lit(False))).alias("unknown"),
        F.sum(w).alias("total"), F.coalesce(F.sum(F.when(F.col("equity"), w)), F.lit(0.0)).alias("exposure"), F.coalesce(F.sum(w * F.col("shock")), F.lit(0.0)).alias("stress"), F.sum(F.least(w, F.lit(limits.asset))).alias("capped"),
    )


def risk_checks(positions: DataFrame, metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(portfolio, category, rule, severity, triggered) of ten rules; metrics(portfolio, max_drawdown, volatility), missing ones count as 0."""
    facts = risk_facts(positions, limits).join(metrics.select("portfolio", "max_drawdown", "volatility"), "portfolio", "left")
    rules = [
        ("DATA", "history_depth", F.when(F.col("shallow") == F.col("assets"), "VETO").otherwise("WARN"), F.col("shallow") > 0), ("DATA", "data_available", F.lit("VETO"), F.col("undated") > 0),
        ("ASSET", "max_single_asset_weight", F.lit("WARN"), F.col("over") > 0), ("ASSET", "liquidity", F.lit("WARN"), F.col("illiquid") > 0), ("ASSET", "known_asset", F.lit("WARN"), F.col("unknown") > 0),
        ("PORTFOLIO", "no_leverage", F.lit("VETO"), F.col("total") > limits.total + 1e-4), ("PORTFOLIO", "equity_exposure", F.lit("VETO"), F.col("exposure") > limits.equity + 1e-9),
        ("PORTFOLIO", "drawdown_limit", F.lit("WARN"), F.abs("max_drawdown") > limits.drawdown), ("PORTFOLIO", "volatility_limit", F.lit("WARN"), F.col("volatility") > limits.volatility), ("PORTFOLIO", "stress_loss", F.lit("VETO"), F.abs("stress") > limits.stress),
    ]
    told = [F.struct(F.lit(c).alias("category"), F.lit(n).alias("rule"), F.when(F.coalesce(t, F.lit(False)), s).otherwise("INFO").alias("severity"), F.coalesce(t, F.lit(False)).alias("triggered")) for c, n, s, t in rules]
    return facts.select("portfolio", "assets", "unseen", "total", "capped", F.explode(F.array(*told)).alias("r")).select("portfolio", "assets", "unseen", "total", "capped", "r.*")


def risk_verdicts(checks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(portfolio, verdict, vetoes, warnings, scale, cash): the gravest severity; weights are cut to the limit of an asset, and scaled too where a veto leaves over the total. What is cut is cash."""
    s = checks.groupBy("portfolio").agg(F.count_if(F.col("severity") == "VETO").alias("vetoes"), F.count_if(F.col("severity") == "WARN").alias("warnings"), F.first("assets").alias("_n"), F.first("unseen").alias("_unseen"), F.first("capped").alias("_capped"))
    verdict = F.when(F.col("vetoes") > 0, "VETO").when(F.col("_unseen") == F.col("_n"), "INSUFFICIENT_DATA").when(F.col("warnings") > 0, "WARN").otherwise("PASS")
    scale = F.when((F.col("vetoes") > 0) & (F.col("_capped") > limits.total + 1e-9), limits.total / F.col("_capped")).otherwise(1.0)
    return s.select("portfolio", verdict.alias("verdict"), "vetoes", "warnings", scale.alias("scale"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("_capped") * scale, F.lit(0.0))).alias("cash"))


def adjusted_weights(positions: DataFrame, verdicts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """positions with verdict and adjusted, the weight that the verdict leaves."""
    return positions.join(verdicts.select("portfolio", "verdict", "scale"), "portfolio").withColumn("adjusted", F.least(F.col("weight"), F.lit(limits.asset)) * F.col("scale")).drop("scale")
