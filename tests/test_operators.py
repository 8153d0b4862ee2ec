"""Closed forms, small literals, sinks and streams."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.functions import filters as X
from asoflab.operators import evaluate as E
from asoflab.operators import optimise as O
from asoflab.operators import pit
from asoflab.operators import timeseries as T
from asoflab.streaming import streams as S


def test_erfc_and_p_value(spark):
    values = [-2.0, -0.5, 0.0, 0.3, 1.0, 2.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", C.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - math.erfc(r["x"])) <= 2e-7 for r in got)


def test_ranks_keep_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None), (2, 5.0)], "k int, x double")
    got = {(r["k"], r["x"]): r for r in df.select("k", "x", C.average_rank("x", "k").alias("a"), C.scaled_rank("x", "k").alias("s"), C.scaled_rank("x", "k", single=0.0).alias("z")).collect()}
    assert got[1, 1.0]["a"] == 1.5 and got[1, 3.0]["a"] == 3.0 and got[1, None]["a"] is None
    assert got[1, 3.0]["s"] == 1.0 and got[2, 5.0]["s"] is None and got[2, 5.0]["z"] == 0.0


def test_asof_join_takes_last_known_and_ignores_the_future(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0), ("a", 7, 30.0)], "k string, t2 int, v double")
    got = {(r["k"], r["t"]): r["asof"] and r["asof"]["v"] for r in pit.asof_join(left, right, ["k"], "t", "t2").collect()}
    assert got == {("a", 5): 20.0, ("a", 1): None, ("b", 9): None}


def test_merge_by_hash_states(spark):
    new = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0)], "k int, h string, v double")
    old = spark.createDataFrame([(2, "y", 9.0), (3, "w", 9.0), (4, "q", 9.0)], "k int, h string, v double")
    got = {r["k"]: (r["state"], r["v"]) for r in pit.merge_by_hash(new, old, ["k"], "h").collect()}
    assert got == {1: ("NEW", 1.0), 2: ("UNCHANGED", 9.0), 3: ("CHANGED", 3.0), 4: ("KEPT", 9.0)}


def test_incremental_build_is_idempotent(spark):
    folder = tempfile.mkdtemp(prefix="asoflab-test-")
    bars = spark.createDataFrame([(1, "2024-01-01", 1.0), (1, "2024-01-02", 2.0)], "symbol int, d string, close double").select("symbol", F.to_date("d").alias("trade_date"), "close")
    days = bars.select("trade_date").distinct()
    log = spark.createDataFrame([], "trade_date date, n long, digest long, status string")
    assert pit.incremental_build(bars, days, log, lambda b: b, f"{folder}/t", f"{folder}/l") == 2
    done = spark.read.parquet(f"{folder}/l")
    assert pit.pending_dates(days, done).count() == 0
    assert spark.read.parquet(f"{folder}/t").count() == 2


def test_filter_policies(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "id int, x double")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(X.applied(df, [X.Node("GT", "x", 10)])) == [3]
    flagged = X.applied(df, [X.Node("GT", "x", 10, policy="INCLUDE_WITH_FLAG")])
    assert ids(flagged) == [2, 3] and flagged.where("id = 2").first()["filter_flags"] == ["MISSING_x"]
    assert ids(X.applied(df, [X.Node("NOT_IN", "x", [5.0])])) == [2, 3]
    with pytest.raises(ValueError):
        X.applied(df, [X.Node("GT", "x", 10, policy="REQUIRE_CLARIFICATION")])


def test_streaks_and_suspensions(spark):
    rows = [(1, d, x) for d, x in enumerate([1, 2, 3, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "symbol int, trade_date int, close int").withColumn("pc", F.lag("close").over(T.SYMBOL))
    got = [r["up"] for r in T.with_streak(df, F.col("close") > F.col("pc"), "up").orderBy("trade_date").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 3]
    ev = spark.createDataFrame([(1, 1, "S", 1), (1, 3, "S", 2), (1, 5, "R", 3), (1, 8, "S", 4)], "symbol int, at int, kind string, event_id int")
    assert sorted((r["start"], r["end"]) for r in T.event_intervals(ev).collect() if r["end"]) == [(1, 5)]


def test_wilder_rsi_and_ema(spark):
    values = [float(10 + (k * 7) % 5) for k in range(40)]
    df = spark.createDataFrame([(values,)], "v array<double>")
    deltas = [b - a for a, b in zip(values, values[1:])]
    g, l = sum(max(d, 0) for d in deltas[:14]) / 14, sum(max(-d, 0) for d in deltas[:14]) / 14
    for d in deltas[14:]:
        g, l = (g * 13 + max(d, 0)) / 14, (l * 13 + max(-d, 0)) / 14
    assert abs(df.select(T.rsi_wilder(F.col("v"))).first()[0] - (100 - 100 / (1 + g / l))) < 1e-9
    e = values[0]
    for v in values[1:]:
        e += (v - e) * 2 / 13
    assert abs(sum(w * v for w, v in zip(T.ema_weights(12, 40), values)) - e) < 1e-9


def test_ledger_fold_crosses_zero(spark):
    rows = [(1, 1, 1, "BUY", 10.0, 5.0, 0.1, 1, None), (1, 1, 2, "BUY", 10.0, 7.0, 0.1, 2, None), (1, 1, 3, "SELL", 25.0, 8.0, 0.1, 3, None), (1, 1, 4, "BUY", 99.0, 1.0, 0.1, 4, "REVERSED")]
    df = spark.createDataFrame(rows, "portfolio long, symbol long, trade_id long, side string, quantity double, price double, fee double, traded_on int, status string")
    r = E.folded_positions(df).first()
    assert r["quantity"] == -5.0 and r["average_cost"] == 8.0 and abs(r["realised"] - 40.0) < 1e-9


def test_capped_weights(spark):
    df = spark.createDataFrame([([8.0, 1.0, 1.0],)], "a array<double>")
    w = df.select(E.capped_weights(F.col("a"), 0.5).alias("w")).first()["w"]
    assert abs(sum(w) - 1) < 1e-9 and max(w) <= 0.5 + 1e-9


def test_residual_removes_linear_exposure_and_is_null_when_singular(spark):
    rows = [(1, float(k), float(k * k), 3.0 * k - 2.0 * k * k + 1) for k in range(8)] + [(2, float(k), float(2 * k), 1.0 * k) for k in range(5)]
    got = E.with_residual(spark.createDataFrame(rows, "g int, a double, b double, y double"), "y", "a", "b", ["g"]).collect()
    assert all(abs(r["residual"]) < 1e-6 for r in got if r["g"] == 1)
    assert all(r["residual"] is None for r in got if r["g"] == 2)


def test_q_values(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p_value double")
    q = {r["id"]: r["q_value"] for r in E.q_values(t).collect()}
    assert abs(q[1] - 0.04) < 1e-9 and abs(q[3] - 0.04 * 4 / 3) < 1e-9 and q[4] == 1.0


def test_components_of_a_chain(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="asoflab-test-"))
    edges = spark.createDataFrame([(k, k + 1) for k in range(80)], "a long, b long")
    got = E.components(edges, spark.range(90).withColumnRenamed("id", "node")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: 0 for k in range(81)} | {k: k for k in range(81, 90)}


def test_future_rows_do_not_change_the_past(spark):
    rows = [(1, d, float(d % 5 + 1)) for d in range(30)]
    df = lambda n: spark.createDataFrame(rows[:n], "symbol int, trade_date int, close double")
    at = lambda d: [tuple(r) for r in d.select("trade_date", C.sma("close", Window.partitionBy("symbol").orderBy("trade_date"), 5)).where("trade_date < 20").orderBy("trade_date").collect()]
    assert at(df(20)) == at(df(30))


def drained(spark, stream, mode):
    q = stream.writeStream.format("memory").queryName(f"q{abs(hash(str(stream))) % 10**8}").outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(q.name).collect()
    finally:
        q.stop()


@pytest.fixture(scope="module")
def quotes(spark):
    folder = tempfile.mkdtemp(prefix="asoflab-quotes-")
    rows = [(k % 3, f"2024-01-0{1 + k // 8} 00:0{k % 8}:00", float(k), f"s{k % 2}") for k in range(24)]
    df = spark.createDataFrame(rows, "symbol long, t string, value double, source string").select("symbol", F.to_timestamp("t").alias("ts"), "value", "source")
    for d in (1, 2, 3):
        df.where(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def test_streams(spark, quotes):
    folder, df = quotes
    stream = lambda: S.source(spark, folder, df.schema)
    last = {r["symbol"]: r["value"] for r in drained(spark, S.latest_quotes(stream()), "complete")}
    want = {r["symbol"]: r["q"]["value"] for r in df.groupBy("symbol").agg(F.max(F.struct("ts", "value")).alias("q")).collect()}
    assert last == want
    ups = {r["symbol"]: r["reports"] for r in drained(spark, S.event_upserts(stream(), "symbol"), "complete")}
    assert ups == {0: 8, 1: 8, 2: 8}
    counts = drained(spark, S.windowed_counts(stream(), ["symbol"], "1 day", delay="5 minutes"), "append")
    assert sum(r["n"] for r in counts) == 16  # the last day's windows are still open
    told = drained(spark, S.distinct_content(stream(), "source", "3 days"), "append")
    assert sorted((r["source"], r["ts"].day) for r in told) == [("s0", 1), ("s1", 1)]
    sessions = drained(spark, S.event_sessions(stream(), ["symbol"], "10 minutes", "5 minutes"), "append")
    days = df.groupBy("symbol", F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("n"), F.min("ts").alias("start")).where("d < 3").collect()
    assert sorted((r["symbol"], r["start"], r["n"]) for r in sessions) == sorted((r["symbol"], r["start"], r["n"]) for r in days)
    ages = spark.createDataFrame([(145,), (146,), (290,), (291,), (None,)], "age int").select(S.freshness(F.col("age")).alias("f")).collect()
    assert [r["f"] for r in ages] == ["FRESH", "DEGRADED", "DEGRADED", "STALE", "STALE"]


def test_running_positions(spark):
    folder = tempfile.mkdtemp(prefix="asoflab-trades-")
    rows = [(1, 1, "2024-01-01 00:00:00", 1, "BUY", 10.0, 5.0), (1, 1, "2024-01-01 00:01:00", 2, "SELL", 4.0, 6.0)]
    df = spark.createDataFrame(rows, "portfolio long, symbol long, t string, trade_id long, side string, quantity double, price double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.mode("append").parquet(folder)
    got = drained(spark, S.running_positions(S.source(spark, folder, df.schema)), "update")[-1]
    assert got["quantity"] == 6.0 and got["average_cost"] == 5.0 and abs(got["realised"] - 4.0) < 1e-9


def grid_weights(n, cap, steps=40):
    """All weights of three assets on a grid."""
    return np.array([(a, b, steps - a - b) for a in range(steps + 1) for b in range(steps + 1 - a) if max(a, b, steps - a - b) <= cap * steps]) / steps


@pytest.mark.parametrize("seed", range(6))
def test_optimised_weights_beat_every_weight_of_a_grid(seed):
    x = np.random.default_rng(seed).normal(0.002, 0.02, (60, 3)) * [1, 2, 0.5] + [0, 0.001, 0]
    cov, excess = np.cov(x.T) * 252, x.mean(axis=0) * 252 - 0.02
    low = O.weights(x, "MIN_VARIANCE", cap=0.6)
    best = O.weights(x, "MAX_SHARPE", cap=0.6)
    for w in (low, best):
        assert abs(w.sum() - 1) < 1e-6 and w.min() >= 0 and w.max() <= 0.6 + 1e-9
    for w in grid_weights(3, 0.6):
        assert low @ cov @ low <= w @ cov @ w + 1e-9
        assert best @ excess / np.sqrt(best @ cov @ best) >= w @ excess / np.sqrt(w @ cov @ w) - 1e-6


def test_risk_parity_closed_forms():
    x = np.random.default_rng(1).normal(0, 0.02, (200, 4)) * [1, 3, 1, 2]
    cov = np.cov(x.T) * 252
    two = O.weights(x[:, :2], "HRP")
    assert two == pytest.approx(1 / np.diag(cov)[:2] / (1 / np.diag(cov)[:2]).sum())
    four = O.weights(np.column_stack([x[:, 0], x[:, 1], x[:, 0] + 1e-9 * x[:, 2], x[:, 1] + 1e-9 * x[:, 3]]), "HRP")
    assert four.sum() == pytest.approx(1) and four[0] == pytest.approx(four[2], rel=1e-3) and four[1] == pytest.approx(four[3], rel=1e-3)
    assert O.weights(np.zeros((30, 3)), "HRP") == pytest.approx([1 / 3] * 3)
    assert O._linked(np.array([[0, 0.9, 0.1], [0.9, 0, 0.8], [0.1, 0.8, 0]])) == [0, 2, 1]


def test_optimised_weights_by_portfolio_and_rebalance(spark):
    rows = [(p, s, t, 0.01 * ((s * 7 + t * 3) % 5 - 2) * (s + 1)) for p in (1, 2) for s in range(3) for t in range(1, 13)] + [(1, 9, 4, 0.1), (1, 9, 5, None)]
    df = spark.createDataFrame(rows, "portfolio int, symbol int, trade_index int, ret double")
    seen = O.lookback_rows(df, window=4, step=2)
    want = sorted((p, s, t, q) for p, s, t, _ in rows for q in range(2, 13, 2) if q - 4 <= t < q)
    assert sorted((r["portfolio"], r["symbol"], r["trade_index"], r["rebalance"]) for r in seen.collect()) == want
    got = {(r["portfolio"], r["rebalance"], r["method"], r["symbol"]): r["weight"] for r in O.optimised_weights(seen, least=4).collect()}
    assert {k[1] for k in got} == {6, 8, 10, 12} and {k[3] for k in got} == {0, 1, 2}  # symbol 9 has too few returns, rebalances 2 and 4 too
    returns = {(p, s, t): x for p, s, t, x in rows}
    for q in (6, 8, 10, 12):
        x = np.array([[returns[1, s, t] for s in range(3)] for t in range(q - 4, q)])
        for m in O.METHODS:
            assert [got[1, q, m, s] for s in range(3)] == pytest.approx(O.weights(x, m))
    assert O.optimised_weights(seen.limit(0)).count() == 0
