"""Queries of fundamental ratios and scores at year ends, from statements of four types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflab.operators import fundamentals as M
from asoflab.plans.registry import query
from asoflab.sources import views as V

#: Orders as records of companies of ten neighbouring customers; twelve companies share a desk's price.
RECORDS_SQL = f"""{V.ctes('bars_c')}, records AS (SELECT o_custkey // 10 AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CASE WHEN quarter(o_orderdate) = 4 THEN 'ANNUAL' ELSE 'INTERIM' END AS period_type, CAST(o_orderdate AS DATE) + 30 AS available, o_orderkey AS k,
  ['balancesheet', 'income', 'cashflow', 'indicator'][o_orderkey % 4 + 1] AS type, o_totalprice AS x, o_orderstatus AS s, o_custkey AS c FROM orders),
cutoffs AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) + 120 AS cutoff FROM orders),
known AS (SELECT *, max(period) OVER (PARTITION BY symbol, cutoff) AS newest FROM records JOIN cutoffs ON available <= cutoff),
picked AS (SELECT * FROM known WHERE period = newest OR period = newest - INTERVAL 12 MONTH QUALIFY row_number() OVER (PARTITION BY symbol, cutoff, type, period ORDER BY available DESC, k DESC) = 1),
sets AS (SELECT symbol, cutoff, any_value(newest) AS period, string_agg(type, ',' ORDER BY type) FILTER (period = newest) AS types, {', '.join(f"any_value({e}) FILTER (type = '{t}' AND period {'=' if now else '<>'} newest) AS {n}" for t, now, n, e in (
    ('balancesheet', True, 'assets', 'x * 3'), ('balancesheet', True, 'liab', 'x * (1 + c % 5 * 0.4)'), ('balancesheet', True, 'equity', 'x * 3 - x * (1 + c % 5 * 0.4)'), ('balancesheet', True, 'shares', 'x / 10'), ('balancesheet', False, 'equity_before', 'x * 3 - x * (1 + c % 5 * 0.4)'),
    ('income', True, 'revenue', 'x'), ('income', True, 'net', "x * CASE s WHEN 'F' THEN 0.1 WHEN 'O' THEN -0.05 ELSE 0 END"), ('income', True, 'invest', "CASE WHEN k % 3 > 0 THEN x * (k % 3) * 0.06 END"), ('income', True, 'annual', "period_type = 'ANNUAL'"),
    ('income', False, 'revenue_before', 'x'), ('income', False, 'net_before', "x * CASE s WHEN 'F' THEN 0.1 WHEN 'O' THEN -0.05 ELSE 0 END"), ('cashflow', True, 'operating', 'x * (k % 7 - 3) / 10'),
    ('indicator', True, 'roe_official', 'CASE WHEN k % 5 > 0 THEN k % 40 - 10.0 END'), ('indicator', True, 'profit_yoy', 'CASE WHEN k % 11 = 0 THEN k % 60 - 20.0 END')))} FROM picked GROUP BY symbol, cutoff),
closes AS (SELECT symbol AS desk, cutoff, arg_max(close, trade_date) AS close FROM bars_c JOIN cutoffs ON trade_date <= cutoff GROUP BY ALL),
valued AS (SELECT s.*, close, close * shares AS value, net / nullif((equity + equity_before) / 2, 0) AS own_roe FROM sets s LEFT JOIN closes z ON z.desk = s.symbol // 12 AND z.cutoff = s.cutoff),
ratios AS (SELECT *, liab / nullif(assets, 0) AS debt_ratio, coalesce(roe_official / 100, own_roe) AS roe, CASE WHEN roe_official IS NOT NULL THEN 'OFFICIAL' WHEN own_roe IS NOT NULL THEN 'CALCULATED' END AS roe_source, revenue / nullif(revenue_before, 0) - 1 AS revenue_growth,
  coalesce(profit_yoy / 100, net / nullif(net_before, 0) - 1) AS profit_growth, value / nullif(equity, 0) AS pb, CASE WHEN annual THEN value / nullif(net, 0) END AS pe, net - invest AS deducted, CASE WHEN net > 0 THEN invest / net END AS invest_ratio FROM valued),
pegged AS (SELECT *, CASE WHEN pe > 0 AND profit_growth > 0 THEN pe / (profit_growth * 100) END AS peg, operating > 0 AS cash_positive FROM ratios),
metrics AS (SELECT *, concat_ws(',', CASE WHEN pe IS NULL THEN 'pe' END, CASE WHEN pb IS NULL THEN 'pb' END, CASE WHEN roe IS NULL THEN 'roe' END, CASE WHEN revenue_growth IS NULL THEN 'revenue_growth' END, CASE WHEN profit_growth IS NULL THEN 'profit_growth' END, CASE WHEN debt_ratio IS NULL THEN 'debt_ratio' END, CASE WHEN operating IS NULL THEN 'operating_cash_flow' END, CASE WHEN peg IS NULL THEN 'peg' END) AS missing,
  coalesce(net IS NOT NULL AND net_before = 0, false) OR coalesce(net IS NOT NULL AND equity + equity_before = 0, false) OR coalesce(value IS NOT NULL AND equity = 0, false) OR coalesce(annual AND value IS NOT NULL AND net = 0, false) OR (peg IS NULL AND (pe IS NOT NULL OR profit_growth IS NOT NULL)) AS broken FROM pegged)"""

_FLAGS = "concat_ws(',', CASE WHEN missing <> '' THEN 'DATA_GAP' END, CASE WHEN roe IS NULL OR revenue_growth IS NULL OR profit_growth IS NULL THEN 'INSUFFICIENT_HISTORY' END, CASE WHEN broken THEN 'INVALID_DENOMINATOR' END, CASE WHEN close IS NULL OR shares IS NULL THEN 'VALUATION_DATA_MISSING' END)"
RATIOS = ("debt_ratio", "roe", "revenue_growth", "profit_growth", "pb", "pe", "peg", "invest_ratio")


def metrics(spark, sf) -> DataFrame:
    o = V.read(spark, sf, "orders")
    x, k, nothing = F.col("o_totalprice"), F.col("o_orderkey"), F.lit(None).cast("double")
    of = lambda n, value: F.when(k % 4 == n, value)
    share = F.when(F.col("o_orderstatus") == "F", 0.1).when(F.col("o_orderstatus") == "O", -0.05).otherwise(0.0)
    liab = x * (1 + F.col("o_custkey") % 5 * 0.4)
    records = o.select(
        F.floor(F.col("o_custkey") / 10).alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"), F.when(F.quarter("o_orderdate") == 4, "ANNUAL").otherwise("INTERIM").alias("period_type"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("available"), k.alias("record_id"), F.element_at(F.array(*map(F.lit, M.TYPES)), (k % 4 + 1).cast("int")).alias("type"),
        of(0, x * 3).alias("total_assets"), of(0, liab).alias("total_liab"), of(0, x * 3 - liab).alias("equity"), of(0, x / 10).alias("shares"), of(1, x).alias("revenue"), of(1, x * share).alias("net_income"),
        of(1, F.when(k % 3 > 0, x * (k % 3) * 0.06)).alias("invest_income"), nothing.alias("deducted"), of(2, x * (k % 7 - 3) / 10).alias("operating"),
        of(3, F.when(k % 5 > 0, k % 40 - 10.0)).alias("roe"), nothing.alias("roe_dt"), nothing.alias("revenue_yoy"), of(3, F.when(k % 11 == 0, k % 60 - 20.0)).alias("profit_yoy"),
    )
    cutoffs = o.select(F.date_add(F.to_date(F.date_trunc("year", "o_orderdate")), 120).alias("cutoff")).distinct()  # years
    closes = V.bars_c(spark, sf).join(F.broadcast(cutoffs), F.col("trade_date") <= F.col("cutoff")).groupBy(F.col("symbol").alias("desk"), "cutoff").agg(F.max_by("close", "trade_date").alias("close"))
    sets = M.statement_sets(records, cutoffs).withColumn("desk", F.floor(F.col("symbol") / 12)).join(closes, ["desk", "cutoff"], "left")
    return M.with_metrics(sets)


@query("DOM_41_fundamental_metrics", f"{RECORDS_SQL} SELECT symbol, cutoff, period, types, {', '.join(f'round({c}, 6) AS {c}' for c in RATIOS)}, round(operating, 4) AS operating_cash_flow, round(deducted, 5) AS deducted, cash_positive, roe_source, missing, {_FLAGS} AS flags FROM metrics")
def fundamental_metrics(spark, sf):
    m = metrics(spark, sf)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return m.select("symbol", "cutoff", "period", joined("types"), *[F.round(c, 6).alias(c) for c in RATIOS], F.round("operating_cash_flow", 4).alias("operating_cash_flow"), F.round("deducted", 5).alias("deducted"), "cash_positive", "roe_source", joined("missing"), joined("flags"))


@query("DOM_42_fundamental_score", f"""{RECORDS_SQL}, parts AS (SELECT symbol, cutoff, deducted, invest_ratio, debt_ratio, pe, cash_positive, list_filter([CASE WHEN roe IS NOT NULL THEN least(1, greatest(-1, (roe - 0.08) / 0.12)) END, CASE WHEN revenue_growth IS NOT NULL THEN least(1, greatest(-1, revenue_growth / 0.25)) END, CASE WHEN debt_ratio IS NOT NULL THEN least(1, greatest(-1, (0.65 - debt_ratio) / 0.35)) END, CASE WHEN cash_positive THEN 0.5 WHEN NOT cash_positive THEN -0.8 END], lambda x: x IS NOT NULL) AS p FROM metrics)
SELECT symbol, cutoff, round(least(coalesce(list_avg(p), 0), CASE WHEN deducted < 0 THEN CASE WHEN invest_ratio > 0.5 THEN -0.75 ELSE -0.6 END ELSE 1 END)::DOUBLE, 6) AS score, round(least(0.9, 0.2 + len(p) * 0.15)::DOUBLE, 6) AS confidence, concat_ws(',', CASE WHEN debt_ratio > 0.75 THEN 'HIGH_DEBT' END, CASE WHEN NOT cash_positive THEN 'NEGATIVE_CASH_FLOW' END, CASE WHEN pe <= 0 THEN 'NON_POSITIVE_PE' END, CASE WHEN deducted < 0 THEN 'DEDUCTED_LOSS' END, CASE WHEN deducted < 0 AND invest_ratio > 0.5 THEN 'NON_RECURRING_PROFIT' END) AS risks FROM parts""")
def fundamental_score(spark, sf):
    s = M.with_fundamental_score(metrics(spark, sf))
    return s.select("symbol", "cutoff", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.array_join("risks", ",").alias("risks"))
