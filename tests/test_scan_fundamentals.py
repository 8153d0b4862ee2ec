"""Scans and fundamentals on rows made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asoflab.functions.filters import Node
from asoflab.operators import fundamentals as M
from asoflab.operators import scan as S

DAY = dt.date(2024, 1, 2)
ROW = "symbol int, change double, volume_ratio double, amount_ratio double, turnover_rate double, volatility double, gap double, amount double, price_volume_state string, breakout boolean, breakdown boolean, limit_rate double, previous_close double, close double, suspended boolean"
MORE = {"technical_score": 0.5, "capital_score": None, "shadow_score": -1.0, "coverage": 0.6, "composite_confidence": None, "amount_percentile": 0.5, "stale": True}


def rows(spark, *data):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(data)], ROW).withColumn("trade_date", F.lit(DAY))
    return df.withColumns({k: F.lit(v).cast("boolean" if isinstance(v, bool) else "double") for k, v in MORE.items()})


def test_anomalies_and_risks(spark):
    df = rows(
        spark, (0.05, 2.0, 2.0, 0.1, 0.6, 0.03, 1e6, "PRICE_UP_VOLUME_UP", True, False, 0.1, 10.0, 11.04, False), (None,) * 10 + (None, 0.0, 5.0, False), (-0.06, 1.0, 0.5, 0.0, 0.1, -0.03, 3e7, "PRICE_DOWN_VOLUME_FLAT", False, True, 0.05, 10.0, 9.5, False),
        (0.9,) * 6 + (1.0, "PRICE_UP_VOLUME_UP", True, True, 0.1, 1.0, 1.1, True),
    )
    got = {r["symbol"]: (r["anomalies"], r["risks"]) for r in S.with_anomalies(df).collect()}
    assert got[0][0] == ["PRICE_SURGE", "VOLUME_SPIKE", "AMOUNT_SPIKE", "HIGH_TURNOVER", "PRICE_UP_VOLUME_UP", "BREAKOUT_HIGH", "VOLATILITY_SPIKE", "GAP_UP", "PRICE_LIMIT_UP", "MULTI_SIGNAL_CONFLUENCE"]
    assert got[0][1] == ["LOW_LIQUIDITY", "EXTREME_VOLATILITY", "MULTI_SIGNAL_CONFLUENCE"] and got[1] == ([], ["PRICE_LIMIT_RULE_UNKNOWN"])
    assert got[2] == (["PRICE_DROP", "LIQUIDITY_DROP", "BREAKDOWN_LOW", "GAP_DOWN", "PRICE_LIMIT_DOWN", "MULTI_SIGNAL_CONFLUENCE"], ["MULTI_SIGNAL_CONFLUENCE"]) and got[3] == ([], ["POSSIBLE_SUSPENSION", "SCANNER_DATA_GAP"])


def test_score_and_cards(spark):
    calm = lambda change, amount: (change, 1.0, 1.0, 0.0, 0.2, 0.0, amount, None, False, False, 0.1, 10.0, 10.0, False)
    df = rows(spark, calm(0.02, 5e7), calm(0.03, 6e7), calm(-0.05, 7e7), calm(-1.0, 9e7), calm(None, 8e7))
    told = {r["symbol"]: r for r in S.scan(df, Node("GTE", "change", 0.0), 2).collect()}
    assert {s: (r["layer"], r["place"]) for s, r in told.items()} == {0: ("CORE", 1), 1: ("CORE", 2), 2: ("NEAR", 1), 3: ("CONTROL", 1), 4: ("CONTROL", 2)}
    assert told[0]["scanner_score"] == pytest.approx(0.2 + 0.15 * 0.75 + 0.1 * 0.6 + 0.07 * 0.5 + 0.03 * 0.5) and told[0]["components"]["capital_flow"] == 0.0
    assert S.scan(df, Node("GTE", "change", 0.0), 2, required=["PRICE_SURGE"]).where("layer = 'CORE'").count() == 0
    s = S.missing_and_matched(df, Node("GTE", "change", 0.0)).first()
    assert (s["universe"], s["matched"], s["near"], s["lacking"]) == (5, 2, 1, 1)


RECORD = "symbol int, period date, type string, period_type string, available date, record_id int, total_assets double, total_liab double, equity double, shares double, revenue double, net_income double, invest_income double, deducted double, operating double, roe double, roe_dt double, revenue_yoy double, profit_yoy double"


def record(symbol, year, kind, available, k, period_type="ANNUAL", **fields):
    names = [c.split()[0] for c in RECORD.split(", ")][6:]
    return (symbol, dt.date(year, 10, 1), kind, period_type, available, k, *[fields.get(n) for n in names])


def test_fundamentals_by_hand(spark):
    known, late = dt.date(2024, 3, 1), dt.date(2024, 6, 1)
    data = [
        record(1, 2023, "balancesheet", known, 1, total_assets=100.0, total_liab=80.0, equity=20.0, shares=10.0), record(1, 2022, "balancesheet", known, 2, equity=30.0), record(1, 2023, "income", known, 3, revenue=0.0, net_income=9.0),
        record(1, 2023, "income", dt.date(2024, 3, 5), 4, revenue=120.0, net_income=5.0, invest_income=6.0), record(1, 2022, "income", known, 5, revenue=100.0, net_income=4.0), record(1, 2023, "income", late, 6, revenue=1.0, net_income=1.0),
        record(1, 2023, "cashflow", known, 7, operating=-1.0), record(2, 2023, "income", known, 8, net_income=3.0), record(2, 2022, "income", known, 9, "INTERIM", net_income=1.0), record(3, 2023, "indicator", late, 10, roe=9.0),
    ]
    cutoffs = spark.createDataFrame([(dt.date(2024, 4, 30),)], "cutoff date")
    sets = M.statement_sets(spark.createDataFrame(data, RECORD), cutoffs).withColumn("close", F.when(F.col("symbol") == 1, 4.0))
    got = {r["symbol"]: r for r in M.with_fundamental_score(M.with_metrics(sets)).collect()}
    assert got.keys() == {1, 2}  # what the cutoff doesn't know isn't there
    a = got[1]
    assert (a["debt_ratio"], a["roe"], a["roe_source"], a["pb"], a["pe"]) == (0.8, 0.2, "CALCULATED", 2.0, 8.0)
    assert a["revenue_growth"] == pytest.approx(0.2) and a["profit_growth"] == pytest.approx(0.25) and a["peg"] == pytest.approx(0.32) and a["deducted"] == -1.0 and a["missing"] == [] and a["flags"] == []
    assert a["score"] == -0.75 and a["confidence"] == pytest.approx(0.8) and a["risks"] == ["HIGH_DEBT", "NEGATIVE_CASH_FLOW", "DEDUCTED_LOSS", "NON_RECURRING_PROFIT"]
    b = got[2]  # the year before is of another period type
    assert b["profit_growth"] is None and b["types"] == ["income"] and b["flags"] == ["DATA_GAP", "INSUFFICIENT_HISTORY", "VALUATION_DATA_MISSING"] and (b["score"], b["confidence"]) == (0.0, pytest.approx(0.2))
