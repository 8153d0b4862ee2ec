"""Queries of decision tables over every symbol and date, and of portfolio risk checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import decisions as D
from asoflab.plans.registry import query
from asoflab.sources import views as V

DIGITS = 8
RISK = D.Limits(asset=0.15, history=50, liquidity=38_000.0)

_ENTRY, _EXIT = "('STRONG_BUY', 'BUY', 'SMALL_BUY')", "('REDUCE', 'EXIT', 'STOP_LOSS')"

DECISION_SQL = f"""{V.ctes('bars_c', 'trades')}, flows AS (SELECT portfolio // 8 AS symbol, traded_on AS trade_date, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS flow FROM trades GROUP BY 1, 2),
path AS (SELECT *, lag(close) OVER w AS pc, lag(trade_date) OVER w AS pd FROM bars_c JOIN flows USING (symbol, trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
wide AS (SELECT *, close / nullif(pc, 0) - 1 AS ret, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM path),
calc AS (SELECT *, coalesce(avg(tr) OVER atr, 0) AS atr, min(low) OVER near AS support, max(high) OVER near AS resistance, round(CASE WHEN count(*) OVER near = 20 THEN least(1, greatest(-1, (close / nullif(avg(close) OVER near, 0) - 1) * 12)) END, 9) AS technical,
  round(CASE WHEN count(*) OVER before = 5 THEN least(1, greatest(-1, log2(amount / nullif(avg(amount) OVER before, 0)) / 2)) END, 9) AS capital, CASE WHEN count(ret) OVER near = 20 THEN round(stddev_samp(ret) OVER near * sqrt(20), 9) END AS volatility,
  greatest(0, coalesce(sum(flow) OVER before, 0)) AS units, avg(close) OVER before AS cost FROM wide
  WINDOW atr AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), near AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), before AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
acct AS (SELECT *, round(0.5 * technical + 0.5 * capital, 9) AS score, round(units / (2 * sum(units) OVER d + 100), 9) AS position, round(sum(units) OVER (PARTITION BY trade_date, symbol % 3) / (2 * sum(units) OVER d + 100), 9) AS sector_position, round(1 - sum(units) OVER d / (2 * sum(units) OVER d + 100), 9) AS cash FROM calc WINDOW d AS (PARTITION BY trade_date)),
q AS (SELECT trade_date, round(quantile_cont(score, 0.9), 9) AS strong_min, round(quantile_cont(score, 0.75), 9) AS buy_min FROM acct GROUP BY 1),
ready AS (SELECT *, CASE WHEN technical IS NULL THEN 'FAILED' WHEN trade_date - pd > 7 THEN 'STALE' WHEN volatility IS NULL OR volume < 40 THEN 'DEGRADED' ELSE 'FRESH' END AS data_status, symbol % 13 <> 12 AS pit, CASE WHEN ret <= -0.02 THEN 'PRICE_DROP' END AS veto, units > 0 AS held, round(close / nullif(cost, 0) - 1, 9) AS unrealized,
  round(((technical IS NOT NULL)::INT + (capital IS NOT NULL)::INT + (volatility IS NOT NULL)::INT) / 3.0::DOUBLE, 9) AS sure, coalesce(ret < 0 AND volatility > 0.045, false) AS reminder, coalesce(volatility > 0.055, false) AS risky FROM acct JOIN q USING (trade_date)),
ruled AS (SELECT *, CASE WHEN data_status = 'FAILED' THEN 'DATA_FAILED_STOP_DECISION' WHEN data_status = 'STALE' THEN 'DATA_STALE_NO_BUY' WHEN NOT pit THEN 'POINT_IN_TIME_FAILED' END AS stopped,
  CASE WHEN held THEN CASE WHEN score >= strong_min AND technical > 0 AND capital > 0 THEN 'SCORE_GE_STRONG_BUY_Q_TREND_CAPITAL_OK' WHEN score >= strong_min THEN 'SCORE_GE_STRONG_BUY_Q_NO_CONFIRM' WHEN score >= buy_min THEN 'SCORE_GE_BUY_Q_HOLD' WHEN score >= -0.5 THEN 'SCORE_BELOW_WATCH_BAND_REDUCE' WHEN unrealized < -0.15 THEN 'SCORE_LT_EXIT_MAX_LOSS_STOP_LOSS' ELSE 'SCORE_LT_EXIT_MAX_EXIT' END
  ELSE CASE WHEN score >= strong_min THEN 'SCORE_GE_STRONG_BUY_Q' WHEN score >= buy_min THEN 'SCORE_GE_BUY_Q' WHEN score >= -0.2 THEN 'SCORE_IN_WAIT_BAND' ELSE 'SCORE_LT_WAIT_AVOID' END END AS why FROM ready),
plain AS (SELECT *, CASE why WHEN 'SCORE_GE_STRONG_BUY_Q' THEN 'STRONG_BUY' WHEN 'SCORE_GE_BUY_Q' THEN 'BUY' WHEN 'SCORE_IN_WAIT_BAND' THEN 'WAIT' WHEN 'SCORE_LT_WAIT_AVOID' THEN 'AVOID' WHEN 'SCORE_GE_STRONG_BUY_Q_TREND_CAPITAL_OK' THEN 'ADD' WHEN 'SCORE_BELOW_WATCH_BAND_REDUCE' THEN 'REDUCE' WHEN 'SCORE_LT_EXIT_MAX_LOSS_STOP_LOSS' THEN 'STOP_LOSS' WHEN 'SCORE_LT_EXIT_MAX_EXIT' THEN 'EXIT' ELSE 'HOLD' END AS act FROM ruled),
acted AS (SELECT *, CASE WHEN stopped IS NOT NULL THEN 'WAIT' WHEN veto IS NOT NULL THEN CASE WHEN held THEN 'EXIT' ELSE 'AVOID' END WHEN reminder AND act IN ('STRONG_BUY', 'BUY') THEN 'SMALL_BUY' ELSE act END AS action,
  array_to_string(list_filter([CASE WHEN data_status = 'DEGRADED' THEN 'DATA_DEGRADED_REDUCE_POSITION' END, stopped, CASE WHEN stopped IS NULL THEN 'VETO_' || veto END, CASE WHEN stopped IS NULL AND veto IS NOT NULL THEN CASE WHEN held THEN 'VETO_EXIT' ELSE 'VETO_AVOID' END END, CASE WHEN stopped IS NULL AND veto IS NULL THEN why END,
  CASE WHEN stopped IS NULL AND veto IS NULL AND reminder AND act IN ('STRONG_BUY', 'BUY') THEN 'SENTIMENT_V3_RISK_REMINDER_DOWNGRADE' END, CASE WHEN stopped IS NULL AND veto IS NULL AND reminder THEN 'SENTIMENT_V3_RISK_REMINDER_CONFIDENCE_PENALTY' END], lambda x: x IS NOT NULL), ',') AS reasons,
  round(CASE WHEN stopped IS NULL AND veto IS NULL AND reminder THEN greatest(0, sure - 0.15) ELSE sure END, 9)::DOUBLE AS confidence FROM plain),
levels AS (SELECT *, least(CASE WHEN atr > 0 THEN close - 2 * atr END, support) AS low_stop, close * 1.01 AS top, CASE WHEN greatest(support, close * 0.95) <= close * 1.01 THEN greatest(support, close * 0.95) ELSE close * 0.95 END AS bottom, greatest(resistance, close * 1.01 * 1.05) AS goal FROM acted),
zones AS (SELECT *, round(CASE WHEN action IN {_ENTRY} THEN bottom END, {DIGITS}) AS entry_low, round(CASE WHEN action IN {_ENTRY} THEN top END, {DIGITS}) AS entry_high, round(CASE WHEN action IN {_ENTRY} AND top > bottom THEN bottom + 0.40::DOUBLE * (top - bottom) END, {DIGITS}) AS preferred_high,
  round(CASE WHEN action IN {_ENTRY} THEN top * 1.02 WHEN action = 'ADD' THEN close * 0.97 END, {DIGITS}) AS add_low, round(CASE WHEN action IN {_ENTRY} THEN top * 1.08 WHEN action = 'ADD' THEN close * 1.02 END, {DIGITS}) AS add_high, round(CASE WHEN action = 'REDUCE' THEN close * 0.98 END, {DIGITS}) AS reduce_low, round(CASE WHEN action = 'REDUCE' THEN close * 1.05 END, {DIGITS}) AS reduce_high,
  round(CASE WHEN action IN {_ENTRY} THEN goal WHEN action = 'ADD' THEN resistance END, {DIGITS}) AS profit_low, round(CASE WHEN action IN {_ENTRY} THEN goal * 1.06 WHEN action = 'ADD' THEN resistance * 1.05 END, {DIGITS}) AS profit_high, round(CASE WHEN action NOT IN {_EXIT} THEN low_stop END, {DIGITS}) AS stop FROM levels),
based AS (SELECT *, CASE WHEN action IN {_ENTRY} AND close > stop THEN round((profit_high - close) / (close - stop), {DIGITS}) END AS risk_reward, CASE WHEN risky THEN 0.05 ELSE 0.2 END::DOUBLE AS most,
  CASE action WHEN 'STRONG_BUY' THEN 0.18 WHEN 'BUY' THEN 0.12 WHEN 'SMALL_BUY' THEN 0.03 WHEN 'ADD' THEN least(position + 0.05, 0.2) WHEN 'REDUCE' THEN greatest(position - 0.05, 0) WHEN 'EXIT' THEN 0 WHEN 'STOP_LOSS' THEN 0 ELSE position END::DOUBLE * CASE WHEN volatility > 0.05 THEN 0.8 ELSE 1 END::DOUBLE * CASE WHEN data_status = 'DEGRADED' THEN 0.5 ELSE 1 END::DOUBLE AS base FROM zones),
sized AS (SELECT *, CASE WHEN action IN {_EXIT} THEN least(base, greatest(0, 0.35 - sector_position), cash, most, position) ELSE least(base, greatest(0, 0.35 - sector_position), cash, most) END AS free, data_status IN ('STALE', 'FAILED') AS still, coalesce(lead(close) OVER (PARTITION BY symbol ORDER BY trade_date), close) AS later FROM based),
final AS (SELECT *, CASE WHEN still THEN position WHEN veto IS NOT NULL THEN least(position, most) ELSE round(free, 4) END AS target, CASE WHEN still OR veto IS NOT NULL THEN 0 ELSE round(free - position, 4) END::DOUBLE AS move FROM sized)"""


def candidates(spark, sf) -> DataFrame:
    """Every symbol and date with what a decision looks at: score, state of data, holdings of the last five bars as shares of one account a day."""
    by = Window.partitionBy("symbol").orderBy("trade_date")
    near, before, day = C.trailing(by, 20), by.rowsBetween(-5, -1), Window.partitionBy("trade_date")
    t = V.trades(spark, sf)
    flows = t.groupBy(F.floor(F.col("portfolio") / 8).alias("symbol"), F.col("traded_on").alias("trade_date")).agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("flow"))
    bars = V.bars_c(spark, sf).join(flows, ["symbol", "trade_date"])
    rows = D.with_levels(bars).withColumns({"ret": C.ratio("close", F.lag("close").over(by)) - 1, "gap": F.datediff("trade_date", F.lag("trade_date").over(by))})
    whole = lambda value, frame, n: F.when(F.count(F.lit(1)).over(frame) == n, value)
    # compared with 0 or other bounds: means of frames differ in their last digits by how they are added up, so all are rounded
    rows = rows.withColumns({
        "technical": F.round(whole(C.clip((C.ratio("close", F.avg("close").over(near)) - 1) * 12), near, 20), 9), "capital": F.round(whole(C.clip(F.log2(C.ratio("amount", F.avg("amount").over(before))) / 2), before, 5), 9),
        "volatility": F.when(F.count("ret").over(near) == 20, F.round(F.stddev_samp("ret").over(near) * F.sqrt(F.lit(20.0)), 9)), "units": F.greatest(F.lit(0.0), F.coalesce(F.sum("flow").over(before), F.lit(0.0))),
        "unrealized": F.round(C.ratio("close", F.avg("close").over(before)) - 1, 9),
    })
    account = 2 * F.sum("units").over(day) + 100
    rows = rows.withColumns({
        "score": F.round(0.5 * F.col("technical") + 0.5 * F.col("capital"), 9), "position": F.round(F.col("units") / account, 9), "sector_position": F.round(F.sum("units").over(Window.partitionBy("trade_date", F.col("symbol") % 3)) / account, 9),
        "cash": F.round(1 - F.sum("units").over(day) / account, 9), "held": F.col("units") > 0, "veto": F.when(F.col("ret") <= -0.02, "PRICE_DROP"), "point_in_time": F.col("symbol") % 13 != 12,
        "data_status": F.when(F.col("technical").isNull(), "FAILED").when(F.col("gap") > 7, "STALE").when(F.col("volatility").isNull() | (F.col("volume") < 40), "DEGRADED").otherwise("FRESH"),
        "confidence": F.round(sum((F.col(c).isNotNull().cast("int") for c in ("technical", "capital", "volatility")), F.lit(0)) / 3.0, 9),
        "reminder": F.coalesce((F.col("ret") < 0) & (F.col("volatility") > 0.045), F.lit(False)), "risky": F.coalesce(F.col("volatility") > 0.055, F.lit(False)),
    })
    return D.with_thresholds(rows)


@query("DOM_62_decision_table", f"""{DECISION_SQL} SELECT symbol, trade_date, action, reasons, confidence, entry_low, entry_high, preferred_high, add_low, add_high, reduce_low, reduce_high, profit_low, profit_high, stop, risk_reward, target, move,
CASE WHEN abs(move) <= 0.001 THEN 0 WHEN abs(move) <= 0.05 THEN 1 WHEN abs(move) <= 0.1 THEN 2 ELSE 3 END AS batches, move > 0.001 AS allowed,
CASE WHEN veto IS NOT NULL THEN '{D.STATUS['void']}' WHEN stop > 0 AND later <= stop THEN '{D.STATUS['broken']}' WHEN action = 'AVOID' THEN '{D.STATUS['void']}' WHEN action IN {_ENTRY} THEN CASE WHEN preferred_high IS NOT NULL AND later < entry_low THEN '{D.STATUS['floor']}' WHEN later <= preferred_high THEN '{D.STATUS['now']}' WHEN later <= entry_high THEN '{D.STATUS['pullback']}' ELSE '{D.STATUS['chase']}' END
WHEN action = 'ADD' OR action IN {_EXIT} THEN '{D.STATUS['now']}' ELSE '{D.STATUS['confirm']}' END AS status FROM final""")
def decision_table(spark, sf):
    zones = ["entry_low", "entry_high", "preferred_high", "add_low", "add_high", "reduce_low", "reduce_high", "profit_low", "profit_high", "stop", "risk_reward"]
    rows = D.decision_table(candidates(spark, sf), digits=DIGITS)
    return rows.select("symbol", "trade_date", "action", F.array_join("reasons", ",").alias("reasons"), F.round("confidence", 9).alias("confidence"), *zones, "target", "move", "batches", "allowed", "status")


POSITIONS_SQL = f"""{V.ctes('trades')}, p AS (SELECT portfolio, symbol, round(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END * price), 2) AS v, count(DISTINCT traded_on) AS history, max(traded_on) AS last, round(avg(quantity * price), 2) AS liquidity FROM trades GROUP BY 1, 2),
positions AS (SELECT *, round(greatest(v, 0) / nullif(greatest(sum(v) OVER (PARTITION BY portfolio), 0), 0), 9) AS weight, symbol < 5 AS equity, CASE WHEN symbol < 5 THEN 0.22 ELSE 0.06 END::DOUBLE AS shock, symbol <> 9 OR portfolio % 2 = 0 AS known FROM p),
metrics AS (SELECT portfolio, least(0, arg_max(price, trade_id) / arg_min(price, trade_id) - 1) AS max_drawdown, stddev_samp(price) / avg(price) AS volatility FROM trades GROUP BY 1),
facts AS (SELECT portfolio, count(*) AS assets, count(*) FILTER (history < {RISK.history}) AS shallow, count(*) FILTER (weight > {RISK.asset} + 1e-9) AS over, count(*) FILTER (liquidity < {RISK.liquidity}) AS illiquid, count(*) FILTER (NOT known) AS unknown, sum(weight) AS total, coalesce(sum(weight) FILTER (equity), 0) AS exposure, coalesce(sum(weight * shock), 0) AS stress, sum(least(weight, {RISK.asset})) AS capped FROM positions GROUP BY 1),
rules AS (SELECT portfolio, capped, unnest([{{'c': 'DATA', 'r': 'history_depth', 's': CASE WHEN shallow = assets THEN 'VETO' ELSE 'WARN' END, 't': shallow > 0}}, {{'c': 'DATA', 'r': 'data_available', 's': 'VETO', 't': false}}, {{'c': 'ASSET', 'r': 'max_single_asset_weight', 's': 'WARN', 't': over > 0}}, {{'c': 'ASSET', 'r': 'liquidity', 's': 'WARN', 't': illiquid > 0}}, {{'c': 'ASSET', 'r': 'known_asset', 's': 'WARN', 't': unknown > 0}},
  {{'c': 'PORTFOLIO', 'r': 'no_leverage', 's': 'VETO', 't': total > 1 + 1e-4}}, {{'c': 'PORTFOLIO', 'r': 'equity_exposure', 's': 'VETO', 't': exposure > 0.5 + 1e-9}}, {{'c': 'PORTFOLIO', 'r': 'drawdown_limit', 's': 'WARN', 't': abs(max_drawdown) > 0.2}}, {{'c': 'PORTFOLIO', 'r': 'volatility_limit', 's': 'WARN', 't': volatility > 0.25}}, {{'c': 'PORTFOLIO', 'r': 'stress_loss', 's': 'VETO', 't': abs(stress) > 0.15}}]) AS x FROM facts JOIN metrics USING (portfolio)),
checks AS (SELECT portfolio, x.c AS category, x.r AS rule, CASE WHEN coalesce(x.t, false) THEN x.s ELSE 'INFO' END AS severity, coalesce(x.t, false) AS triggered, capped FROM rules),
verdicts AS (SELECT portfolio, count(*) FILTER (severity = 'VETO') AS vetoes, count(*) FILTER (severity = 'WARN') AS warnings, any_value(capped) AS capped FROM checks GROUP BY 1),
told AS (SELECT portfolio, CASE WHEN vetoes > 0 THEN 'VETO' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, vetoes, warnings, CASE WHEN vetoes > 0 AND capped > 1 + 1e-9 THEN 1 / capped ELSE 1 END AS scale, capped FROM verdicts)"""


def positions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Holdings of each portfolio as shares of its net value, and its fall and volatility."""
    t = V.trades(spark, sf)
    p = t.groupBy("portfolio", "symbol").agg(F.round(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")) * F.col("price")), 2).alias("v"), F.countDistinct("traded_on").alias("history"), F.max("traded_on").alias("last"), F.round(F.avg(F.col("quantity") * F.col("price")), 2).alias("liquidity"))
    worth = F.greatest(F.sum("v").over(Window.partitionBy("portfolio")), F.lit(0.0))
    held = p.withColumns({"weight": F.round(C.ratio(F.greatest(F.col("v"), F.lit(0.0)), worth), 9), "equity": F.col("symbol") < 5, "shock": F.when(F.col("symbol") < 5, 0.22).otherwise(0.06), "known": (F.col("symbol") != 9) | (F.col("portfolio") % 2 == 0)})
    fall = F.least(F.lit(0.0), F.max_by("price", "trade_id") / F.min_by("price", "trade_id") - 1)
    return held, t.groupBy("portfolio").agg(fall.alias("max_drawdown"), (F.stddev_samp("price") / F.avg("price")).alias("volatility"))


@query("DOM_61_check_rows", f"{POSITIONS_SQL} SELECT portfolio, category, rule, severity, triggered FROM checks")
def check_rows(spark, sf):
    return D.risk_checks(*positions(spark, sf), RISK).select("portfolio", "category", "rule", "severity", "triggered")


@query("DOM_61_verdicts", f"{POSITIONS_SQL} SELECT portfolio, verdict, vetoes, warnings, round(scale, 6) AS scale, round(greatest(0, 1 - coalesce(capped * scale, 0)), 6) AS cash FROM told")
def verdicts(spark, sf):
    v = D.risk_verdicts(D.risk_checks(*positions(spark, sf), RISK), RISK)
    return v.select("portfolio", "verdict", "vetoes", "warnings", F.round("scale", 6).alias("scale"), F.round("cash", 6).alias("cash"))


@query("DOM_61_adjusted_weights", f"{POSITIONS_SQL} SELECT portfolio, symbol, verdict, weight, round(least(weight, {RISK.asset}) * scale, 6) AS adjusted FROM positions JOIN told USING (portfolio)")
def adjusted_weights(spark, sf):
    held, metrics = positions(spark, sf)
    a = D.adjusted_weights(held, D.risk_verdicts(D.risk_checks(held, metrics, RISK), RISK), RISK)
    return a.select("portfolio", "symbol", "verdict", "weight", F.round("adjusted", 6).alias("adjusted"))
