"""Fundamental ratios at cutoffs: the statements known by then, the year before, valuation, missing fields, flags and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import clip, ratio

#: Types of statements, and the metrics whose lack is a gap, in this order.
TYPES = ("balancesheet", "income", "cashflow", "indicator")
CORE = ("pe", "pb", "roe", "revenue_growth", "profit_growth", "debt_ratio", "operating_cash_flow", "peg")


def statement_sets(records: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(symbol, cutoff, period, types, and a struct for each type and its year-ago comparable, {type} and {type}_before).

    records(symbol, period, type, period_type, available, record_id, fields...): of those available by the cutoff the newest
    period counts, and of each type in it the record that became available last. The comparable one is of the same type and
    period type, a year earlier. Cutoffs are few and broadcast; one shuffle by symbol and cutoff.
    """
    fields = [c for c in records.columns if c not in ("symbol", "type", "record_id")]
    known = records.join(F.broadcast(cutoffs.select("cutoff")), F.col("available") <= F.col("cutoff"))
    newest = F.max("period").over(Window.partitionBy("symbol", "cutoff"))
    near = known.withColumn("newest", newest).where((F.col("period") == F.col("newest")) | (F.col("period") == F.add_months("newest", -12)))
    row, order = F.struct(*fields), F.struct("available", "record_id")
    pick = lambda t, now: F.max_by(F.when((F.col("type") == t) & ((F.col("period") == F.col("newest")) == now), row), F.when((F.col("type") == t) & ((F.col("period") == F.col("newest")) == now), order))
    sets = near.groupBy("symbol", "cutoff").agg(
        F.first("newest").alias("period"), F.sort_array(F.collect_set(F.when(F.col("period") == F.col("newest"), F.col("type")))).alias("types"),
        *[pick(t, True).alias(t) for t in TYPES], *[pick(t, False).alias(f"{t}_before") for t in ("balancesheet", "income")],
    )
    same = lambda t: F.when(F.col(f"{t}_before.period_type").eqNullSafe(F.col(f"{t}.period_type")) & F.col(t).isNotNull(), F.col(f"{t}_before"))
    return sets.withColumns({f"{t}_before": same(t) for t in ("balancesheet", "income")})


def _zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(numerator.isNotNull() & (denominator == 0), F.lit(False))


def with_metrics(sets: DataFrame) -> DataFrame:
    """sets(symbol, cutoff, close, ...) of ``statement_sets`` with the ratios, missing (an array of CORE names) and flags.

    Fields: balancesheet total_assets, total_liab, equity, shares; income revenue, net_income, invest_income, deducted;
    cashflow operating; indicator roe, roe_dt, revenue_yoy, profit_yoy in percent, which win over what is calculated.
    """
    c = F.col
    equity, before = c("balancesheet.equity"), c("balancesheet_before.equity")
    income, income_before = c("income.net_income"), c("income_before.net_income")
    value = c("close") * c("balancesheet.shares")
    annual = c("income.period_type") == "ANNUAL"
    own_roe = ratio(income, (equity + before) / 2)
    out = sets.withColumns({
        "debt_ratio": ratio("balancesheet.total_liab", "balancesheet.total_assets"), "operating_cash_flow": c("cashflow.operating"), "roe": F.coalesce(c("indicator.roe") / 100, own_roe), "roe_dt": c("indicator.roe_dt") / 100,
        "roe_source": F.when(c("indicator.roe").isNotNull(), "OFFICIAL").when(own_roe.isNotNull(), "CALCULATED"),
        "revenue_growth": F.coalesce(c("indicator.revenue_yoy") / 100, ratio("income.revenue", "income_before.revenue") - 1), "profit_growth": F.coalesce(c("indicator.profit_yoy") / 100, ratio(income, income_before) - 1),
        "pb": ratio(value, equity), "pe": F.when(annual, ratio(value, income)), "deducted": F.coalesce(c("income.deducted"), income - c("income.invest_income")), "invest_ratio": F.when(income > 0, ratio("income.invest_income", income)),
    })
    out = out.withColumn("peg", F.when((c("pe") > 0) & (c("profit_growth") > 0), c("pe") / (c("profit_growth") * 100))).withColumn("cash_positive", c("operating_cash_flow") > 0)
    priced = c("close").isNotNull() & c("balancesheet.shares").isNotNull()
    broken = _zero(c("balancesheet.total_liab"), c("balancesheet.total_assets")) | _zero(income, (equity + before) / 2) | _zero(c("income.revenue"), c("income_before.revenue")) | _zero(income, income_before) | (priced & (_zero(value, equity) | (F.coalesce(annual, F.lit(False)) & _zero(value, income))))
    broken = broken | (c("peg").isNull() & (c("pe").isNotNull() | c("profit_growth").isNotNull()))
    missing = F.array_compact(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in CORE]))
    tell = lambda condition, name: F.when(condition, F.lit(name))
    out = out.withColumn("missing", missing)
    flags = [tell(F.size("missing") > 0, "DATA_GAP"), tell(c("roe").isNull() | c("revenue_growth").isNull() | c("profit_growth").isNull(), "INSUFFICIENT_HISTORY"), tell(broken, "INVALID_DENOMINATOR"), tell(~priced, "VALUATION_DATA_MISSING")]
    return out.withColumn("flags", F.array_compact(F.array(*flags)))


def with_fundamental_score(metrics: DataFrame) -> DataFrame:
    """metrics with score in [-1, 1], confidence and risks: the mean of the components that are there, at most -0.6 where profit
    without investment income is negative, and -0.75 where that income is more than half of the profit besides."""
    c = F.col
    parts = [
        clip((c("roe") - 0.08) / 0.12), clip(c("revenue_growth") / 0.25), clip((F.lit(0.65) - c("debt_ratio")) / 0.35),
        F.when(c("cash_positive"), 0.5).when(~c("cash_positive"), -0.8),
    ]
    seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    mean = F.coalesce(F.try_divide(total, seen.cast("double")), F.lit(0.0))
    most = F.when(c("deducted") < 0, F.when(c("invest_ratio") > 0.5, -0.75).otherwise(-0.6)).otherwise(1.0)
    tell = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    risks = F.array_compact(F.array(tell(c("debt_ratio") > 0.75, "HIGH_DEBT"), tell(~c("cash_positive"), "NEGATIVE_CASH_FLOW"), tell(c("pe") <= 0, "NON_POSITIVE_PE"), tell(c("deducted") < 0, "DEDUCTED_LOSS"), tell((c("deducted") < 0) & (c("invest_ratio") > 0.5), "NON_RECURRING_PROFIT")))
    return metrics.withColumns({"score": F.least(mean, most), "confidence": F.least(F.lit(0.9), F.lit(0.2) + seen * 0.15), "risks": risks})
