"""What must not grow with the input faster than the input: plans, sizes of states, and results on either side of a change."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import evaluate as E
from asoflab.operators import moments as M
from asoflab.operators import optimise as O
from asoflab.operators import outcomes as T
from asoflab.operators import pit
from asoflab.operators import timeseries as TS
from asoflab.operators import research as R
from asoflab.operators import walkforward as W
from asoflab.plans import correlations as K
from asoflab.plans import deeper as D
from asoflab.plans import features as PF
from asoflab.plans import joins as J
from asoflab.plans import trading as P
from asoflab.sources import views as V
from conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quintile_counts_distinct_values_without_a_set(spark):
    values = [1.0, 1.0, 2.0, 3.0, 4.0, None, 5.0, 5.0]
    df = spark.createDataFrame([("a", x) for x in values] + [("b", x) for x in (1.0, 2.0, 3.0, 4.0, 4.0, None)], "d string, x double")
    told = df.select("d", "x", C.quintile("x", "d").alias("q"))
    assert "collect_set" not in plan(told)
    got = {(r["d"], r["x"]): r["q"] for r in told.collect()}
    assert got["a", 1.0] == 2 and got["a", 5.0] == 5 and got["a", None] is None
    assert {q for (d, _), q in got.items() if d == "b"} == {None}  # four distinct values


def test_nearest_keeps_its_sum_far_from_the_simplex():
    w = np.array([1e9, 1e9 - 0.25, 1e9 - 0.5, 0.0])
    assert abs(O.nearest(w, 0.6).sum() - 1) < 1e-6  # halving an interval of 1e9 45 times leaves 3e-5
    for seed in range(50):
        rng = np.random.default_rng(seed)
        w, cap = rng.normal(size=7), rng.uniform(1 / 7, 1)
        x = O.nearest(w, cap)
        moved = (w - x)[(x > 1e-12) & (x < cap - 1e-12)]
        assert abs(x.sum() - 1) < 1e-9 and x.min() >= 0 and x.max() <= cap
        assert not len(moved) or np.ptp(moved) < 1e-9


def test_a_target_without_a_price_is_cash(spark):
    prices = [(s, f"2024-01-{d:02d}", d, c) for s, closes in (("a", (10.0, 11.0, 12.0, 12.0)), ("b", (0.0, 5.0, 5.0, 5.0))) for d, c in enumerate(closes, 1)]
    df = spark.createDataFrame(prices, "symbol string, trade_date string, trade_index int, close double")
    targets = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (3, "a", 1.0)], "rebalance_index int, symbol string, weight double")
    got = [r["nav"] for r in E.segment_nav(df, targets).orderBy("trade_date").collect()]
    assert got == pytest.approx([1.0, 1.05, 1.1, 1.1])


def test_entries_on_the_bound_of_the_zone_are_the_querys_and_the_sqls(spark, duck):
    rows = [(close, atr, round(close + atr / 2, 2)) for close, atr in ((103.33, 2.14), (88.35, 3.4), (97.85, 0.08), (100.0, 0.5))]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "symbol int, close double, atr double, open double")
    bar = F.struct(F.lit("d").alias("trade_date"), "open", F.col("open").alias("high"), F.col("open").alias("low"), F.col("open").alias("close"), F.col("close").alias("previous_close"))
    df = df.select("symbol", "close", "atr", F.lit(70.0).alias("score"), F.lit(0.1).alias("rate"), (F.col("close") - F.col("atr")).alias("zone_low"), (F.col("close") + F.col("atr")).alias("zone_high"), F.array(bar).alias("future"))
    bought = {r["symbol"] for r in T.trades(df, (1,)).collect()}
    for k, (close, atr, entry) in enumerate(rows):
        inside = duck.execute(f"SELECT {P._INSIDE} FROM (SELECT {close!r}::DOUBLE AS close, {atr!r}::DOUBLE AS atr, [{{'o': {entry!r}::DOUBLE}}] AS f)").fetchone()[0]
        assert inside == (k in bought)


def test_windows_and_folds_of_indicators_stand_once_in_a_plan(spark):
    df = spark.createDataFrame([(1, k, float(10 + k * 7 % 5)) for k in range(80)], "symbol int, trade_date int, close double")
    by = TS.history("close", Window.partitionBy("symbol").orderBy("trade_date"), 60)
    for told in (TS.rsi_wilder(by), TS.macd(by), TS.kdj(by), TS.ema_finite("close", Window.partitionBy("symbol").orderBy("trade_date"), 12)):
        text = plan(df.select("symbol", told.alias("x")))
        assert text.count("collect_list") == 1, text
    folded = df.select("symbol", TS.kdj(by).alias("e"))
    text = plan(folded.select("e.k", "e.d", "e.j"))
    assert text.count("aggregate(") == 1, text


def test_a_days_rows_move_once_for_all_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(f"2024-01-{d:02d}", *map(float, rng.integers(0, 6, 3)), bool(rng.random() < 0.3), None if rng.random() < 0.05 else float(rng.integers(-4, 5)) / 10) for d in range(1, 25) for _ in range(40)]
    df = spark.createDataFrame(rows, "trade_date string, tech double, fund double, sent double, risk boolean, ret double").withColumn("trade_date", F.to_date("trade_date"))
    own = [(f"c{k}", f"2024-01-{d:02d}", [0.1 * k, 0.5, 0.2], 0.05 * k, 1.0 - 0.2 * k) for k in range(4) for d in range(1, 25 - k)]
    weights = spark.createDataFrame(own, "candidate string, trade_date string, weights array<double>, penalty double, risk_scale double").withColumn("trade_date", F.to_date("trade_date"))
    told = W.scored_days(df, weights, ("tech", "fund", "sent"), "risk")
    assert " Join " not in plan(told) and "Window" not in plan(told)
    f = df.join(weights, "trade_date")
    score = F.col("weights")[0] * F.col("tech") + F.col("weights")[1] * F.col("fund") + F.col("weights")[2] * F.col("sent") - F.col("penalty") * F.col("risk").cast("double")
    plain = f.select("candidate", "trade_date", F.lit(1).alias("symbol"), F.round(score, 9).alias("score"), "ret", F.when(F.col("risk"), F.col("risk_scale")).otherwise(1.0).alias("scale"))
    a, b = ({(r["candidate"], r["trade_date"]): r.asDict() for r in x.collect()} for x in (W.traded_days(told, ["candidate"], 30, 5), W.candidate_days(plain, ["candidate"], 30, 5)))
    assert a.keys() == b.keys() and len(a) > 50
    for key, x in a.items():
        for name, value in x.items():
            assert b[key][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (key, name)


def test_ranks_of_packed_chunks_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 50)
    monkeypatch.setattr(M, "RANGE", 40)
    rng = np.random.default_rng(4)
    x = [[None if v % 7 == 0 else float(v) / 4 for v in map(int, rng.integers(0, most, 900))] for most in (3, 30, 5000)]
    x[0] = [-0.0 if k % 3 else v for k, v in enumerate(x[0])]
    df = spark.createDataFrame(list(zip(*x)), "a double, b double, c double").repartition(3)
    ranked = M.spread_ranks(df, ["a", "b", "c"]).collect()
    got = {(r["kind"], r["i"], r["j"]): r for r in M.pair_moments(df, ["a", "b", "c"]).collect()}
    assert len(got) == 6
    for (kind, i, j), r in got.items():
        pairs = [(v[0], v[1]) for v in ((row["ranks"][i], row["ranks"][j]) if kind else (row["abc"[i]], row["abc"[j]]) for row in ranked) if None not in v]
        assert r["n"] == len(pairs)
        for name, f in (("sx", lambda a, b: a), ("sy", lambda a, b: b), ("sxx", lambda a, b: a * a), ("syy", lambda a, b: b * b), ("sxy", lambda a, b: a * b)):
            assert r[name] == pytest.approx(sum(f(a, b) for a, b in pairs))
    assert "posexplode(array" not in plan(M.pair_moments(df, ["a", "b", "c"]))


def test_average_ranks_of_a_key_take_one_sort(spark):
    df = spark.createDataFrame([("a", x) for x in (2.0, 1.0, 2.0, None, 3.0, None)] + [("b", 5.0)], "d string, x double")
    told = df.select("d", "x", C.average_rank("x", "d").alias("r"), C.pct_rank("x", "d").alias("p"))
    text = told._jdf.queryExecution().sparkPlan().toString()
    assert plan(told).count("Window [") == 2, text  # by the order, and the count of the key
    got = sorted(((r["d"], r["x"] or 0.0, r["r"], r["p"]) for r in told.collect()), key=str)
    assert got == sorted([("a", 0.0, None, None), ("a", 0.0, None, None), ("a", 1.0, 1.0, 0.25), ("a", 2.0, 2.5, 0.625), ("a", 2.0, 2.5, 0.625), ("a", 3.0, 4.0, 1.0), ("b", 5.0, 1.0, 1.0)], key=str)


def test_allocations_hold_no_window_of_a_whole_sector(spark):
    told = plan(D.allocations(spark, SF))
    windows = [x for x in told.splitlines() if "Window [" in x]
    assert windows and not [x for x in windows if "min(symbol" in x]


def test_both_revisions_come_from_one_set_of_bars(spark):
    told = plan(PF.latest_revision(spark, SF))
    assert told.count("parquet") == 1 and "Union" not in told


def test_cohorts_see_both_ends_of_a_holding_only(spark):
    told = plan(P.observations(spark, SF))
    assert "collect_list" not in told and "lead(" in told


def test_a_day_of_packets_moves_once_for_all_methods_and_labels(spark):
    r = np.random.default_rng(4)
    packets = [(s, d, *(None if r.random() < 0.1 else float(r.integers(0, 6)) for _ in "ab"), 1.0) for d in ("2024-01-02", "2024-01-03") for s in range(13)]
    labels = [(s, d, kind, h, float(r.normal()), "COMPLETE" if r.random() < 0.9 else "PARTIAL") for s, d, *_ in packets for kind in ("X", "Y") for h in (1, 5)]
    left = spark.createDataFrame(packets, "symbol long, trade_date string, a double, b double, same double").withColumn("trade_date", F.to_date("trade_date"))
    right = spark.createDataFrame(labels, "symbol long, trade_date string, label_type string, horizon int, ret double, status string").withColumn("trade_date", F.to_date("trade_date"))
    days = R.method_days(left, right, ("a", "b", "same"), 5)
    told = plan(days)
    assert "Window" not in told and "Expand" not in told
    got = {(x["method"], x["label_type"], x["horizon"], str(x["trade_date"])): x for x in days.collect()}
    keys = ["method", "label_type", "horizon", "trade_date"]
    pairs = left.unpivot(["symbol", "trade_date"], ["a", "b", "same"], "method", "x").where("x IS NOT NULL").join(right.where("status = 'COMPLETE'").withColumnRenamed("ret", "y"), ["symbol", "trade_date"])
    ranked = pairs.withColumns({"rx": C.min_rank("x", *keys), "ry": C.min_rank("y", *keys), "q": F.ntile(5).over(Window.partitionBy(*keys).orderBy("x", "symbol"))})
    want = ranked.groupBy(*keys).agg(F.count("*").alias("n"), C.pearson("x", "y").alias("ic"), C.pearson("rx", "ry").alias("rank_ic"), F.avg(F.when(F.col("q") == 5, F.col("y"))).alias("q5"), F.avg(F.when(F.col("q") == 1, F.col("y"))).alias("q1")).where("n >= 5").collect()
    assert len(want) == len(got) == 24
    for x in want:
        y = got[x["method"], x["label_type"], x["horizon"], str(x["trade_date"])]
        assert y["n"] == x["n"]
        for c in ("ic", "rank_ic", "q5", "q1"):
            assert y[c] == pytest.approx(x[c], abs=1e-12) if x[c] is not None else y[c] is None, c


def test_a_price_grid_is_spread_before_it_grows(spark):
    bars = spark.createDataFrame([(s, "2024-01-02", 1.0) for s in range(40)], "symbol long, trade_date string, close double").selectExpr("*", "close AS open", "close AS high", "close AS low")
    days = spark.createDataFrame([("2024-01-02", 1), ("2024-01-03", 2)], "trade_date string, trade_index int")
    grid = E.price_grid(bars, days, (1,))
    assert grid.count() == 80
    assert grid.select(F.spark_partition_id().alias("p")).distinct().count() > 2  # small as it is


def test_intervals_are_counted_without_a_row_for_each_pair(spark):
    told = plan(J.intervals(spark, SF))
    assert "Join" not in told and "Aggregate" not in told
    r = np.random.default_rng(8)
    day = lambda: f"2024-01-{int(r.integers(1, 29)):02d}"
    points = spark.createDataFrame([(int(r.integers(5)), day() if r.random() < 0.9 else None) for _ in range(200)], "k int, d string").select("k", F.to_date("d").alias("d"))
    rows = [(int(r.integers(4)) if r.random() < 0.9 else None, day() if r.random() < 0.9 else None, day() if r.random() < 0.7 else None, "P" if r.random() < 0.3 else None) for _ in range(40)]
    spans = spark.createDataFrame(rows, "k int, a string, b string, s string").select("k", F.to_date("a").alias("a"), F.to_date("b").alias("b"), "s")
    got = sorted(tuple(x) for x in pit.covering(points, spans, "k", "d", "a", "b", {"n": F.lit(True), "p": F.col("s") == "P"}).collect())
    joined = pit.interval_join(points.distinct(), spans, "k", "d", "a", "b").groupBy("k", "d").agg(F.count("*").alias("n"), F.count_if(F.col("s") == "P").alias("p"))
    assert got == sorted(tuple(x) for x in joined.collect()) and len(got) > 50


def test_features_of_arrays_are_those_of_windows(spark):
    bars = V.bars_c(spark, SF)
    keep = F.pmod(F.xxhash64("symbol", "trade_date"), F.lit(9))
    bars = bars.select("symbol", "trade_date", *[F.when(keep != k, F.col(c)).alias(c) for k, c in enumerate(("open", "close", "high", "low"))], F.when(keep != 4, F.when(keep != 5, F.col("volume")).otherwise(0.0)).alias("volume"), F.when(keep != 6, F.col("amount")).alias("amount"))
    want = bars.selectExpr("symbol", "trade_date", *[f"round({e}, 6) AS {n}" for n, (_, e) in K.FEATURES.items()]).toPandas().sort_values(["symbol", "trade_date"])
    rows = bars.toPandas().sort_values(["symbol", "trade_date"])
    got = K.made({c: rows[c].to_numpy(float) for c in rows.columns if c not in ("trade_date",)})
    assert len(rows) > 1000
    for name, x in zip(K.NAMES, got, strict=True):
        y = want[name].to_numpy(float)
        assert (np.isnan(x) == np.isnan(y)).all(), name
        assert np.nanmax(np.abs(x - y)) < 2e-6, name


def test_arrays_are_told_in_few_bytes_and_exactly():
    r = np.random.default_rng(5)
    for x in (r.integers(0, 50, 9000) / 1.0, r.integers(-10**9, 10**9, 9000) / 100, r.normal(size=9000), np.array([]), np.array([np.nan, 1.5, np.inf, -np.inf, 0.0]), np.r_[r.integers(0, 9, 50) / 1.0, np.nan]):
        for rising in (False, True):
            y = np.sort(x) if rising else x
            assert np.array_equal(M._read(M._told(y, rising)), y, equal_nan=True)
    ranks = np.cumsum(r.integers(1, 200, 9000)).astype(float)
    assert len(M._told(ranks, True)) < 1.3 * len(ranks)  # eight bytes each before


def test_bars_of_correlations_move_once_and_codes_do_not(spark):
    told = V.bars_c(spark, SF, together=True).sortWithinPartitions("symbol", "trade_date")._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange hashpartitioning(symbol") == 1 and told.count("Exchange") == 1, told
    assert "codes" not in M.PACKED


def test_chunks_hold_whole_keys(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 50)
    rows = [(float(s), float(k)) for s in range(40) for k in range(s + 1)]
    df = spark.createDataFrame(rows, "s double, v double").repartition(3, "s").sortWithinPartitions("s", "v")
    steps = lambda x: [x["v"], np.r_[np.nan, np.where(np.diff(x["s"]) == 0, np.diff(x["v"]), np.nan)] if len(x["v"]) else x["v"]]
    (r,) = [x for x in M.pair_moments(df, ["v", "step"], steps, "s").collect() if x["kind"] == 0]
    assert r["n"] == len(rows) - 40 and r["sy"] == len(rows) - 40
