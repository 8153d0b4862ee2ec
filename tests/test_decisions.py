"""Decision tables and risk checks on rows whose answers are known."""

import datetime as dt

from pyspark.sql import functions as F

from asoflab.operators import decisions as D

FIELDS = "symbol int, trade_date date, close double, atr double, support double, resistance double, score double, strong_min double, buy_min double, technical double, capital double, confidence double, data_status string, point_in_time boolean, veto string, held boolean, unrealized double, reminder boolean, position double, sector_position double, cash double, volatility double, risky boolean"
BASE = {"symbol": 1, "trade_date": dt.date(2024, 1, 1), "close": 10.0, "atr": 0.2, "support": 9.8, "resistance": 10.3, "score": 0.5, "strong_min": 0.42, "buy_min": 0.22, "technical": 0.5, "capital": 0.5, "confidence": 0.7, "data_status": "FRESH", "point_in_time": True, "veto": None, "held": False, "unrealized": None, "reminder": False, "position": 0.0, "sector_position": 0.0, "cash": 1.0, "volatility": 0.01, "risky": False}


def decided(spark, *changes, digits=2):
    rows = [tuple((BASE | {"symbol": k} | c).values()) for k, c in enumerate(changes)]
    return [r for r in D.decision_table(spark.createDataFrame(rows, FIELDS), digits=digits).orderBy("symbol", "trade_date").collect()]


def test_actions_in_order_of_priority(spark):
    held = {"held": True, "position": 0.1}
    cases = [
        ({"data_status": "FAILED", "veto": "X"}, "WAIT", ["DATA_FAILED_STOP_DECISION"]), ({"data_status": "STALE"}, "WAIT", ["DATA_STALE_NO_BUY"]), ({"point_in_time": False, "data_status": "DEGRADED"}, "WAIT", ["DATA_DEGRADED_REDUCE_POSITION", "POINT_IN_TIME_FAILED"]),
        ({"veto": "FRAUD"}, "AVOID", ["VETO_FRAUD", "VETO_AVOID"]), (held | {"veto": "FRAUD"}, "EXIT", ["VETO_FRAUD", "VETO_EXIT"]), ({}, "STRONG_BUY", ["SCORE_GE_STRONG_BUY_Q"]), ({"score": 0.3}, "BUY", ["SCORE_GE_BUY_Q"]), ({"score": -0.2}, "WAIT", ["SCORE_IN_WAIT_BAND"]), ({"score": None}, "AVOID", ["SCORE_LT_WAIT_AVOID"]),
        ({"reminder": True}, "SMALL_BUY", ["SCORE_GE_STRONG_BUY_Q", "SENTIMENT_V3_RISK_REMINDER_DOWNGRADE", "SENTIMENT_V3_RISK_REMINDER_CONFIDENCE_PENALTY"]), (held, "ADD", ["SCORE_GE_STRONG_BUY_Q_TREND_CAPITAL_OK"]), (held | {"capital": None}, "HOLD", ["SCORE_GE_STRONG_BUY_Q_NO_CONFIRM"]),
        (held | {"score": 0.25}, "HOLD", ["SCORE_GE_BUY_Q_HOLD"]), (held | {"score": -0.5}, "REDUCE", ["SCORE_BELOW_WATCH_BAND_REDUCE"]), (held | {"score": -0.6, "unrealized": -0.16}, "STOP_LOSS", ["SCORE_LT_EXIT_MAX_LOSS_STOP_LOSS"]), (held | {"score": -0.6}, "EXIT", ["SCORE_LT_EXIT_MAX_EXIT"]),
    ]
    got = decided(spark, *[c for c, _, _ in cases])
    assert [(r["action"], r["reasons"]) for r in got] == [(a, why) for _, a, why in cases]
    assert [r["confidence"] for r in got][9] == 0.7 - 0.15 and got[4]["recommend_exit"] and not got[4]["recommend_reduce"]


def test_zones_and_sizes(spark):
    plain, thin, low, add, cut, free = decided(
        spark, {}, {"data_status": "DEGRADED", "volatility": 0.06}, {"support": 10.5, "atr": 0.0}, {"held": True, "position": 0.18}, {"held": True, "position": 0.12, "score": -0.3}, {"close": 0.0},
    )
    assert [plain[c] for c in ("entry_low", "entry_high", "preferred_high", "add_low", "add_high", "profit_low", "profit_high", "stop")] == [9.8, 10.1, 9.92, 10.3, 10.91, 10.61, 11.24, 9.6]
    assert plain["risk_reward"] == 3.1 and (plain["target"], plain["move"], plain["batches"], plain["allowed"]) == (0.18, 0.18, 3, True)
    assert (thin["target"], thin["batches"]) == (0.072, 2)
    assert (low["entry_low"], low["stop"]) == (9.5, 10.5)
    assert (add["add_low"], add["add_high"], add["profit_high"], add["target"], add["batches"]) == (9.7, 10.2, 10.82, 0.2, 1)
    assert (cut["reduce_low"], cut["reduce_high"], cut["stop"], cut["target"], cut["allowed"]) == (9.8, 10.5, None, 0.07, False)
    assert free["entry_low"] is None and free["stop"] is None


def test_status_at_the_next_close(spark):
    later = [(9.9, "now"), (10.05, "pullback"), (10.2, "chase"), (9.7, "floor"), (9.6, "broken")]
    changes = [c for k, (price, _) in enumerate(later) for c in ({"symbol": k}, {"symbol": k, "trade_date": dt.date(2024, 1, 2), "close": price, "score": 0.0})]
    got = [r for r in decided(spark, *changes) if r["trade_date"] == dt.date(2024, 1, 1)]
    assert [r["status"] for r in got] == [D.STATUS[s] for _, s in later]
    assert decided(spark, {"veto": "X"})[0]["status"] == D.STATUS["void"]
    assert D.decision_table(spark.createDataFrame([], FIELDS)).count() == 0


def test_levels_of_short_and_null_histories(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 4)]
    bars = spark.createDataFrame([(1, days[0], 11.0, 9.0, 10.0), (1, days[1], 12.0, 11.0, 11.5), (1, days[2], None, None, None)], "symbol int, trade_date date, high double, low double, close double")
    got = D.with_levels(bars).orderBy("trade_date").collect()
    assert [(r["atr"], r["support"], r["resistance"]) for r in got] == [(0.0, 9.0, 11.0), (2.0, 9.0, 12.0), (2.0, 9.0, 12.0)]


def test_risk_verdicts_cut_weights_and_leave_cash(spark):
    fields = "portfolio string, symbol string, weight double, history int, last date, liquidity double, equity boolean, shock double, known boolean"
    day = dt.date(2024, 1, 1)
    rows = [
        ("fine", "A", 0.4, 300, day, 3e7, True, 0.1, True), ("fine", "B", 0.5, 300, day, 3e7, False, 0.1, True), ("heavy", "A", 0.8, 300, day, 3e7, False, 0.1, True), ("levered", "A", 0.7, 300, day, 3e7, False, 0.0, True), ("levered", "B", 0.6, 300, day, 3e7, False, 0.0, True),
        ("empty", "A", 0.5, None, None, None, False, None, None), ("young", "A", 0.3, 10, day, 3e7, False, 0.0, True), ("young", "B", 0.3, 300, day, 1e7, False, 0.0, False),
    ]
    held = spark.createDataFrame(rows, fields)
    metrics = spark.createDataFrame([("fine", -0.1, 0.2), ("heavy", -0.3, 0.3)], "portfolio string, max_drawdown double, volatility double")
    checks = D.risk_checks(held, metrics)
    told = {r["portfolio"]: r for r in D.risk_verdicts(checks).collect()}
    triggered = {p: {r["rule"] for r in checks.where("triggered").collect() if r["portfolio"] == p} for p in told}
    assert triggered["fine"] == set() and triggered["heavy"] == {"max_single_asset_weight", "drawdown_limit", "volatility_limit"}
    assert triggered["levered"] == {"max_single_asset_weight", "no_leverage"} and triggered["young"] == {"history_depth", "liquidity", "known_asset"}
    assert {p: r["verdict"] for p, r in told.items()} == {"fine": "PASS", "heavy": "WARN", "levered": "VETO", "empty": "VETO", "young": "WARN"}
    assert abs(told["heavy"]["cash"] - 0.4) < 1e-12 and told["levered"]["cash"] < 1e-12
    adjusted = {(r["portfolio"], r["symbol"]): r["adjusted"] for r in D.adjusted_weights(held, D.risk_verdicts(checks)).collect()}
    assert adjusted["heavy", "A"] == 0.6 and abs(adjusted["levered", "A"] - 0.5) < 1e-12
    assert D.risk_checks(held.where(F.lit(False)), metrics).count() == 0
