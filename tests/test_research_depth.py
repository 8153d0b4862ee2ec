"""Trade outcomes, cohorts, walk-forward studies, entity audits, replay inputs and correlations against plain versions."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.functions import sql
from asoflab.operators import entities as N
from asoflab.operators import moments as M
from asoflab.operators import outcomes as O
from asoflab.operators import replay as P
from asoflab.operators import walkforward as W
from asoflab.sources import shared

DAY = dt.date(2024, 1, 1)


# trades under rules


def plain_trade(signal, future, horizon, scenario, rules):
    """(base, reason, exit date, price, net) of one signal, or None where it doesn't buy; future: (date, o, h, l, c, previous close)."""
    close, atr, rate = signal["close"], signal["atr"], signal["rate"]
    if signal["score"] < scenario.buy_score or len(future) < horizon or not future[0][1]:
        return None
    entry = future[0][1]
    low, high = close - atr, close + atr
    if not low <= entry <= low + scenario.zone_width * (high - low) or future[horizon - 1][4] is None:
        return None
    stop = close - scenario.stop_atr * atr
    base = future[horizon - 1][4]
    for b in future[:horizon]:
        if b[1] is not None and stop > 0 and b[3] <= stop:
            base = min(b[1], stop)
            break
    shut = lambda b: any(x is None for x in b[1:5])
    flat = lambda b: max(b[1:5]) - min(b[1:5]) <= 1e-9
    base = base / entry - 1
    if shut(future[0]):
        return base, "SUSPENDED_OR_MISSING_ENTRY", None, None, None
    if flat(future[0]):
        return base, "ONE_PRICE_ENTRY", None, None, None
    if future[0][5] and entry >= future[0][5] * (1 + rate) * (1 - rules.tolerance):
        return base, "LIMIT_UP_ENTRY", None, None, None
    due, price = max(horizon - 1, 1), None
    for i in range(1, min(due + 1, len(future))):
        if not shut(future[i]) and stop > 0 and future[i][3] <= stop:
            due, price = i, min(future[i][1], stop)
            break
    reason = "NO_EXECUTABLE_EXIT"
    for i in range(due, len(future)):
        b = future[i]
        if shut(b):
            reason = "SUSPENDED_OR_MISSING_EXIT"
        elif flat(b):
            reason = "ONE_PRICE_EXIT"
        elif b[5] and b[4] <= b[5] * (1 - rate) * (1 + rules.tolerance):
            reason = "LIMIT_DOWN_EXIT"
        else:
            out = price if i == due and price is not None else b[4]
            net = out * (1 - rules.slippage) * (1 - rules.sell_commission - rules.stamp_duty) / (entry * (1 + rules.slippage) * (1 + rules.buy_commission)) - 1
            return base, None, b[0], out, net
    return base, reason, None, None, None


def test_trades_match_a_plain_version_for_every_reason(spark):
    r = random.Random(11)
    scenario, rules = O.Scenario(stop_atr=0.8), O.Rules()
    rows, plain = [], {}
    for s in range(60):
        last, bars = 100.0, []
        for d in range(24):
            kind = r.random()
            if kind < 0.15:
                bars.append((DAY + dt.timedelta(days=d), None, None, None, None))
                continue
            o, c = (round(last * x, 2) for x in (r.choice([1.0, 1.015, 0.995]), r.choice([0.9, 0.97, 1.0, 1.04])))
            if kind < 0.3:
                o = c
            bars.append((DAY + dt.timedelta(days=d), o, max(o, c) if kind < 0.3 else max(o, c) + 0.5, min(o, c) if kind < 0.3 else min(o, c) - r.choice([0.1, 3.0]), c))
            last = c
        rows += [(s, d + 1, *b) for d, b in enumerate(bars)]
        plain[s] = bars
    grid = spark.createDataFrame(rows, "symbol int, trade_index int, trade_date date, open double, high double, low double, close double")
    signals = O.with_future(grid, 8).where("close IS NOT NULL").select("symbol", "trade_index", "trade_date", "close", F.lit(4.0).alias("atr"), (F.col("symbol") + 40.0).alias("score"), F.lit(0.012).alias("rate"), (F.col("close") - 4).alias("zone_low"), (F.col("close") + 4).alias("zone_high"), "future")
    got = {(x["symbol"], x["trade_date"], x["horizon"]): (x["base_return"], x["reason"], x["exit_date"], x["exit_price"], x["net_return"]) for x in O.trades(signals, (1, 3, 5), scenario, rules).collect()}
    want = {}
    for s, bars in plain.items():
        for d, b in enumerate(bars):
            closes = [x[4] for x in bars[: d + 1] if x[4] is not None]
            future, known = [], closes[-1] if closes else None
            for x in bars[d + 1 : d + 9]:
                future.append((*x, known))
                known = x[4] if x[4] is not None else known
            for h in (1, 3, 5):
                told = b[4] is not None and plain_trade({"close": b[4], "atr": 4.0, "rate": 0.012, "score": s + 40.0}, future, h, scenario, rules)
                if told:
                    want[s, b[0], h] = told
    assert got.keys() == want.keys()
    for k, told in want.items():
        assert [x if x is None or isinstance(x, (str, dt.date)) else pytest.approx(x, rel=1e-12) for x in told] == list(got[k]), k
    assert {t[1] for t in want.values()} >= {None, "ONE_PRICE_ENTRY", "LIMIT_UP_ENTRY", "SUSPENDED_OR_MISSING_EXIT", "ONE_PRICE_EXIT", "LIMIT_DOWN_EXIT"}


def observed(spark, rows):
    return spark.createDataFrame(rows, "k string, trade_date date, symbol int, rank int, score double, ret double, benchmark double, exit_date date")


def test_cohorts_do_not_overlap(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    rows = [("a", day(n), 1, 1, 1.0, 0.1, None, day(n + w)) for n, w in ((0, 4), (2, 1), (4, 9), (5, 2), (7, 1), (8, 1), (20, 3))]
    o = observed(spark, rows)
    taken = lambda rule: [(x["trade_date"] - DAY).days for x in O.cohorts(o, ["k"], 3, rule).orderBy("cohort").collect()]
    assert taken("AFTER_EXIT") == [0, 5, 8, 20] and taken("EVERY_HORIZON") == [0, 5, 20] and taken("FIRST") == [0] and len(taken("ALL")) == 7


def test_cohort_portfolio_by_hand(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    rows = [("a", day(0), s, s, x, y, 0.01, day(3)) for s, x, y in ((1, 6.0, 0.1), (2, 3.0, -0.2), (3, 1.0, 0.4), (4, 9.0, 9.9))]
    rows += [("a", day(5), 1, 1, -1.0, 0.5, 0.02, day(8)), ("a", day(5), 9, 2, 0.0, -0.1, None, day(8))]
    p = O.cohort_positions(observed(spark, rows), ["k"], 1, 3, 0.5)
    w = {(x["cohort"], x["symbol"]): x["weight"] for x in p.collect()}
    assert w == pytest.approx({(1, 1): 0.5, (1, 2): 0.375, (1, 3): 0.125, (2, 1): 0.5, (2, 9): 0.5})
    s = {x["cohort"]: x for x in O.cohort_series(p, ["k"], 0.01).collect()}
    first, second = 0.5 * 0.1 - 0.375 * 0.2 + 0.125 * 0.4, 0.2
    assert s[1]["ret"] == pytest.approx(first) and s[1]["turnover"] == pytest.approx(1.0) and s[2]["turnover"] == pytest.approx((0 + 0.375 + 0.125 + 0.5) / 2)
    m = O.cohort_metrics(O.cohort_series(p, ["k"], 0.01), ["k"], least=2).first()
    assert m["gross"] == pytest.approx((1 + first) * (1 + second) - 1) and m["net"] == pytest.approx(m["gross"] - 0.01 * 1.5)
    assert m["sharpe"] == pytest.approx(np.mean([first, second]) / np.std([first, second]) * 252**0.5) and m["benchmark_return"] == pytest.approx(1.01 * 1.02 - 1)


# walk-forward


def study(spark, days=90, symbols=12, seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for s in range(symbols):
            x = r.normal(size=2)
            rows.append((s, DAY + dt.timedelta(days=d), float(x[0]), float(x[1]), 1.0, None if r.random() < 0.05 else float(0.4 * x[0] - 0.2 * x[1] + r.normal())))
    return rows


STUDY = "symbol int, trade_date date, a double, b double, c double, y double"


def plain_ridge(rows, window, block, purge):
    dates = sorted({x[1] for x in rows})
    out = {}
    for start in range(window + purge, len(dates), block):
        inside = set(dates[start - purge - window : start - purge])
        train = np.array([x[2:] for x in rows if x[1] in inside and x[5] is not None])
        x, y = train[:, :3], train[:, 3]
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd[sd == 0] = 1.0
        z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
        beta = np.linalg.solve(z.T @ z + np.diag([0.0, 1, 1, 1]), z.T @ y)
        for row in rows:
            if row[1] in dates[start : start + block]:
                out[row[0], row[1]] = float(np.concatenate([[1.0], (np.array(row[2:5]) - mean) / sd]) @ beta)
    return out


def test_ridge_matches_a_plain_version_and_knows_nothing_of_the_purged_dates(spark):
    rows = study(spark)
    run = lambda rows: {(x["symbol"], x["trade_date"]): x["prediction"] for x in W.purged_ridge(spark.createDataFrame(rows, STUDY), ["a", "b", "c"], "y", 20, 10, 5).collect()}
    got, want = run(rows), plain_ridge(rows, 20, 10, 5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    dates = sorted({x[1] for x in rows})
    block = set(dates[45:55])  # trained on dates 20 to 39
    purged = set(dates[40:])
    changed = [(*x[:5], 99.0) if x[1] in purged else x for x in rows]
    other = run(changed)
    assert all(other[k] == got[k] for k in got if k[1] in block) and any(other[k] != got[k] for k in got if k[1] in set(dates[75:85]))


def test_rolling_weights_look_no_nearer_than_the_purge(spark):
    r = np.random.default_rng(0)
    daily = [(DAY + dt.timedelta(days=d), *(float(x) for x in r.normal(0.05, 0.1, 3))) for d in range(60)]
    make = lambda rows: {(x["trade_date"], x["method"], x["shrink"]): x["weights"] for x in W.rolling_weights(spark.createDataFrame(rows, "trade_date date, tech double, fund double, sent double"), ("tech", "fund", "sent"), (10,), (0.25, 1.0), 25).collect()}
    got = make(daily)
    assert {d for d, _, _ in got} == {x[0] for x in daily[35:]}
    at = daily[40][0]
    h = np.array([x[1:] for x in daily[5:15]])
    for method, raw in (("ROLLING_RANK_IC", h.mean(axis=0)), ("RANK_IC_IR", h.mean(axis=0) / h.std(axis=0, ddof=1)), ("STABILITY", h.mean(axis=0) / (1 + h.std(axis=0, ddof=1)))):
        p = np.maximum(raw, 0)
        w = np.clip(0.25 * np.array(W.BASELINE) + 0.75 * (p / p.sum() if p.sum() else np.array(W.BASELINE)), W.LOWER, W.UPPER)
        assert got[at, method, 0.25] == pytest.approx(w / w.sum())
    later = make([x if k < 15 else (x[0], 9.0, -9.0, 0.0) for k, x in enumerate(daily)])
    assert later[at, "STABILITY", 0.25] == got[at, "STABILITY", 0.25] and later[daily[59][0], "STABILITY", 0.25] != got[daily[59][0], "STABILITY", 0.25]


def test_candidate_metrics_by_hand(spark):
    rows = []
    for d in range(41):
        for s in range(10):
            rows.append(("x", DAY + dt.timedelta(days=d), s, float(s), (s - 4.5) / 100 * (1 if d != 20 else -1), 0.5 if s == 9 else 1.0))
    scored = spark.createDataFrame(rows, "candidate string, trade_date date, symbol int, score double, ret double, scale double")
    days = W.candidate_days(scored, ["candidate"], 10)
    assert {x["trade_date"]: round(x["rank_ic"], 9) for x in days.collect()} == {DAY + dt.timedelta(days=d): (-1.0 if d == 20 else 1.0) for d in range(41)}
    m = {x["cost_bp"]: x for x in W.candidate_metrics(days, ["candidate"], (0, 40)).collect()}
    net = [0.045 * 0.5, -0.045 * 0.5, 0.045 * 0.5]
    assert m[0]["mean_return"] == pytest.approx(np.mean(net)) and m[0]["periods"] == 3 and m[0]["sharpe"] == pytest.approx(np.mean(net) / np.std(net, ddof=1) * 12.6**0.5)
    assert m[40]["mean_return"] == pytest.approx(np.mean(net) - 0.5 * 0.004) and m[0]["max_drawdown"] == pytest.approx(-0.0225)
    none = W.candidate_metrics(W.candidate_days(scored, ["candidate"], 11), ["candidate"])
    assert none.count() == 0


# entities


def test_entity_audit_tiers(spark):
    universe = spark.createDataFrame([(1, "1001"), (2, "1002"), (3, "1003")], "symbol long, code string")
    aliases = spark.createDataFrame([("Red River Bank", "FULL_NAME", 1), ("Red River", "SHORT_NAME", 2), ("Oak", "SHORT_NAME", 3), ("Green Hill", "SHORT_NAME", 1), ("green hill", "SHORT_NAME", 3), ("Elm Tree", "SHORT_NAME", 3)], "alias string, kind string, symbol long")
    texts = [("see 1002, RED river", 3), ("code 1002 and 1003", 9), ("code 1002; 1002", None), ("the RED River bank", None), ("a red, river here", None), ("oak", None), ("green hill", None), ("Elm tree by Red River Bank", None), (None, None), ("91002", 77), ("elm-tree ELM TREE", None)]
    docs = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(texts)], "doc_id long, text string, payload_symbol long")
    got = {x["doc_id"]: (x["symbol"], x["link_type"], x["matched"], x["confidence"], x["status"]) for x in N.entity_audit(docs, universe, aliases).collect()}
    assert got == {
        0: (3, "SOURCE_SYMBOL", "3", 1.0, "LINKED"), 1: (None, "AMBIGUOUS_CODES", None, 0.0, "UNLINKED_AMBIGUOUS"), 2: (2, "TEXT_SYMBOL", "1002", 0.99, "LINKED"),
        3: (1, "FULL_NAME", "red river bank", 0.98, "LINKED"), 4: (2, "SHORT_NAME", "red river", 0.9, "LINKED"), 5: (None, "NO_RELIABLE_MATCH", None, 0.0, "UNLINKED"),
        6: (None, "AMBIGUOUS_ALIAS", None, 0.0, "UNLINKED_AMBIGUOUS"), 7: (None, "AMBIGUOUS_ALIAS", None, 0.0, "UNLINKED_AMBIGUOUS"), 8: (None, "NO_RELIABLE_MATCH", None, 0.0, "UNLINKED"),
        9: (None, "NO_RELIABLE_MATCH", None, 0.0, "UNLINKED"), 10: (3, "SHORT_NAME", "elm tree", 0.9, "LINKED"),
    }


# replay inputs


def test_several_asof_sides_cross_one_shuffle(spark):
    left = spark.createDataFrame([(s, k, DAY + dt.timedelta(days=k)) for s in (1, 2) for k in range(6)], "symbol int, trade_index int, trade_date date").repartition(3)
    a = spark.createDataFrame([(1, DAY, 5, "x"), (1, DAY, 10, "y"), (1, DAY + dt.timedelta(days=3), 1, "z"), (1, None, 9, "never")], "symbol int, known date, version int, v string")
    b = spark.createDataFrame([(2, DAY + dt.timedelta(days=4), 7.0)], "symbol int, since date, w double")
    out = P.asof_many(left, {"a": (a, "known", ["version"]), "b": (b, "since", [])}, "symbol", "trade_date")
    got = {(x["symbol"], x["trade_index"]): (x["a"] and x["a"]["v"], x["b"] and x["b"]["w"]) for x in out.collect()}
    assert got == {(s, k): (("z" if k >= 3 else "y") if s == 1 else None, 7.0 if s == 2 and k >= 4 else None) for s in (1, 2) for k in range(6)}
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = P.asof_many(left, {"a": (a, "known", ["version"]), "b": (b, "since", [])}, "symbol", "trade_date", {"n": F.count("*").over(Window.partitionBy("symbol"))})
        physical = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert physical.count("Exchange hashpartitioning(symbol") == 1 and "Join" not in plan


def test_readiness_lists_missing_dates(spark):
    calendar = spark.createDataFrame([(DAY + dt.timedelta(days=k), k + 1) for k in range(40_000)], "trade_date date, trade_index int")
    complete = [(1, k + 1) for k in range(40_000)] + [(2, k + 1) for k in range(40_000) if k not in (0, 8, 32_768, 39_999)]
    registry = spark.createDataFrame([("full", 1), ("full", 1), ("both", 1), ("both", 2), ("none", 5)], "feature string, source int")
    got = {x["feature"]: x for x in P.readiness(registry, spark.createDataFrame(complete, "source int, trade_index int"), calendar).collect()}
    assert got["full"]["ready"] and got["full"]["covered"] == 40_000 and got["full"]["missing"] == [] and got["full"]["sources"] == 1
    assert [(d - DAY).days for d in got["both"]["missing"]] == [0, 8, 32_768, 39_999] and not got["both"]["ready"] and got["both"]["sources"] == 2
    assert got["none"]["covered"] == 0 and len(got["none"]["missing"]) == 40_000


# correlations


def test_correlations_of_many_columns_match_pandas(spark):
    r = np.random.default_rng(4)
    x = pd.DataFrame({"hot": np.where(r.random(3000) < 0.5, 1.0, r.integers(0, 4, 3000)), "b": r.normal(size=3000), "flat": 5.0, "rare": np.where(r.random(3000) < 0.995, np.nan, 1.0)})
    x["c"] = x["b"] * -2 + r.normal(size=3000)
    x.loc[r.random(3000) < 0.2, "c"] = np.nan
    names = ["hot", "b", "flat", "rare", "c"]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x[names].to_numpy()], ", ".join(f"{n} double" for n in names)).repartition(7)
    ranks = {x["row"]: x["ranks"] for x in M.spread_ranks(df, names).collect()}
    want = x[names].rank()
    assert sorted(tuple(-1 if v is None else v for v in row) for row in ranks.values()) == sorted(tuple(-1 if np.isnan(v) else v for v in row) for row in want.to_numpy())
    got = {(y["a"], y["b"]): (y["n"], y["pearson"], y["spearman"]) for y in M.all_correlations(df, names).collect()}
    for a, b in itertools.combinations(names, 2):
        both = x[[a, b]].dropna()
        n, p, s = got[a, b]
        assert n == len(both)
        if "flat" in (a, b) or len(both) < 20:
            assert p is None and s is None
        else:
            assert p == pytest.approx(both[a].corr(both[b]), abs=1e-9) and s == pytest.approx(want.loc[both.index, a].corr(want.loc[both.index, b]), abs=1e-9)


def test_families(spark):
    shared.checkpoint_dir(spark)
    pairs = spark.createDataFrame([("a", "b", 0.9, 0.1), ("b", "c", 0.1, -0.85), ("c", "d", 0.8, None), ("d", "e", None, None)], "a string, b string, pearson double, spearman double")
    features = spark.createDataFrame([(n, "X" if n < "c" else "Y") for n in "abcde"], "feature string, semantic string")
    got = sorted(tuple(x) for x in M.feature_families(pairs, features).collect())
    assert got == [("CORRELATION", "a", n) for n in "abc"] + [("SEMANTIC", "X" if n < "c" else "Y", n) for n in "abcde"]


# SQL functions


def test_sql_functions_are_the_column_functions(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame([(1.0, 2.0, "Ｆull－Width ＡＢ_1 «é»", 3, 5), (1.0, 0.0, "it's a \\ b", 1, 1), (None, 2.0, None, 2, 2), (-9.0, -3.0, "", 4, 4)], "x double, y double, t string, k long, n long")
    pairs = {
        "safe_ratio(x, y)": C.ratio("x", "y"), "clipped(x, -1, 1)": C.clip("x"), "plain_title(t)": C.normalised_text("t"), "average_place(k, n)": F.col("k") + (F.col("n") - 1) / 2.0,
        "scaled_place(k, n, true)": F.try_divide((F.col("k") - 1).cast("double"), F.nullif(F.col("n") - 1, F.lit(0))) * 2 - 1,
    }
    for text, column in pairs.items():
        rows = df.select(F.expr(text).alias("a"), column.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], text
    assert [r[0] for r in spark.sql("SELECT freshness(x) FROM VALUES (145D), (290D), (291D) t(x)").collect()] == ["FRESH", "DEGRADED", "STALE"]
