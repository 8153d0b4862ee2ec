"""Queries of the remaining rows: scores, scan outcomes, factor families, baskets, weights, research tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import evaluate as E
from asoflab.operators import pit
from asoflab.operators import timeseries as T
from asoflab.plans.features import A, B, BY, PATH, RETS, r, rets
from asoflab.plans.registry import query
from asoflab.plans.research import BDAYS, EVAL, scored
from asoflab.sources import files, shared
from asoflab.sources import views as V


@query("SNK_9_audit_rows", """SELECT o_orderkey, 'run_' || substr(sha256('plan-1'), 1, 32) AS run_id, 'item_' || substr(sha256('plan-1|' || o_orderkey), 1, 32) AS item_id FROM orders WHERE o_orderstatus = 'P'""")
def audit_rows(spark, sf):
    return files.audit_rows(V.read(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "plan-1", ["o_orderkey"])


@query("TS_12_regime_score", f"""{A}, s AS (SELECT symbol, trade_date, close, avg(close) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, avg(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60, count(*) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n, close / nullif(lag(close, 20) {BY}), 0) - 1 AS g FROM bars_a),
t AS (SELECT *, least(1, greatest(-1, (m20 / nullif(m60, 0) - 1) * 12)) * 0.5 - CASE WHEN abs(close / nullif(m20, 0) - 1) > 0.2 THEN 0.2 ELSE 0 END * CASE WHEN g <= -0.05 THEN 1.5 WHEN g >= 0.05 THEN 0.5 ELSE 1 END AS x FROM s WHERE n = 60) SELECT symbol, trade_date, round(least(1, greatest(-1, x)), 5) AS score FROM t""")
def regime_score(spark, sf):
    s = V.bars_a(spark, sf).withColumns({"m20": C.sma("close", T.SYMBOL, 20), "m60": C.sma("close", T.SYMBOL, 60), "g": C.ratio("close", F.lag("close", 20).over(T.SYMBOL)) - 1}).where("m60 IS NOT NULL")
    penalty = F.when(F.abs(C.ratio("close", "m20") - 1) > 0.2, 0.2).otherwise(0.0) * F.when(F.col("g") <= -0.05, 1.5).when(F.col("g") >= 0.05, 0.5).otherwise(1.0)
    return r(s, ["symbol", "trade_date"], 5, score=C.clip(C.clip((C.ratio("m20", "m60") - 1) * 12) * 0.5 - penalty))


@query("TS_18_turnover_streaks", f"""{A}, k AS (SELECT symbol, trade_date, volume, row_number() {BY}) AS k FROM bars_a), p AS (SELECT a.symbol, a.trade_date, a.k, CASE WHEN count(b.volume) = 20 THEN count(*) FILTER (WHERE b.volume <= a.volume) / 20.0::DOUBLE END AS pct FROM k a LEFT JOIN k b ON a.symbol = b.symbol AND b.k BETWEEN a.k - 20 AND a.k - 1 GROUP BY 1, 2, 3)
SELECT symbol, trade_date, round(pct, 4) AS pct, k - coalesce(max(CASE WHEN NOT coalesce(pct >= 0.7, false) THEN k END) {BY} ROWS UNBOUNDED PRECEDING), 0) AS high_days FROM p""")
def turnover_streaks(spark, sf):
    p = V.bars_a(spark, sf).withColumn("pct", T.share_not_above("volume", T.SYMBOL, 20))
    return T.with_streak(p, F.col("pct") >= 0.7, "high_days").select("symbol", "trade_date", F.round("pct", 4).alias("pct"), "high_days")


@query("TS_28_strength_levels", f"""{A}, {PATH}, x AS (SELECT (close - pc) / nullif(pc, 0) AS ret, (close - low) / nullif(high - low, 0) AS loc FROM path) SELECT CASE WHEN ret IS NULL THEN 'UNKNOWN' WHEN ret > 0.05 AND coalesce(loc, 1) > 0.8 THEN 'STRONG' WHEN ret > 0 THEN 'FIRM' WHEN ret > -0.05 THEN 'SOFT' ELSE 'WEAK' END AS level, count(*) AS n FROM x GROUP BY 1""")
def strength_levels(spark, sf):
    level = F.when(F.col("ret").isNull(), "UNKNOWN").when((F.col("ret") > 0.05) & (F.coalesce("close_location", F.lit(1.0)) > 0.8), "STRONG").when(F.col("ret") > 0, "FIRM").when(F.col("ret") > -0.05, "SOFT").otherwise("WEAK")
    return T.path_features(V.bars_a(spark, sf)).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("DOM_2_score_frame", f"""{B}, {RETS} SELECT symbol, trade_date, (ret IS NOT NULL)::INT + 1 + (volume >= 3)::INT AS coverage, round((coalesce(least(1, greatest(-1, ret)) * 0.9 * 0.5, 0) + least(1, amount / 400) * 0.8 * 0.3 + CASE WHEN volume >= 3 THEN 1.0 * 0.5 * 0.2 ELSE 0 END) / nullif(CASE WHEN ret IS NULL THEN 0 ELSE 0.45 END + 0.24 + CASE WHEN volume >= 3 THEN 0.1 ELSE 0 END, 0), 6) AS score FROM rets""".replace("coalesce(least(1, greatest(-1, ret)) * 0.9 * 0.5, 0)", "CASE WHEN ret IS NULL THEN 0 ELSE least(1, greatest(-1, ret)) * 0.9 * 0.5 END"))
def score_frame(spark, sf):
    parts = [(C.clip("ret"), 0.9, 0.5), (F.least(F.lit(1.0), F.col("amount") / 400), 0.8, 0.3), (F.when(F.col("volume") >= 3, 1.0), 0.5, 0.2)]
    # confidence times weight of the scores that are there, folded inside one array
    own = F.filter(F.array(*[F.struct(v.alias("v"), F.lit(c * w).alias("w")) for v, c, w in parts]), lambda x: x["v"].isNotNull())
    total = F.aggregate(own, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a["s"] + x["v"] * x["w"]).alias("s"), (a["w"] + x["w"]).alias("w")))
    return rets(spark, sf).withColumns({"own": own, "t": total}).select("symbol", "trade_date", F.size("own").alias("coverage"), F.round(C.ratio(F.col("t.s"), F.col("t.w")), 6).alias("score"))


@query("DOM_4_scan_outcomes", f"""{BDAYS}, t AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k, close, lead(close, 1) {BY}) AS c1, lead(close, 5) {BY}) AS c5, max(high) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS hi, min(low) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS lo FROM bars_b) SELECT trade_date, count(*) AS n, round(avg(c1 / nullif(close, 0) - 1), 5) AS r1, round(avg(c5 / nullif(close, 0) - 1), 5) AS r5, round(max(hi / nullif(close, 0) - 1), 5) AS best, round(min(lo / nullif(close, 0) - 1), 5) AS worst FROM t WHERE k <= 20 GROUP BY 1""")
def scan_outcomes(spark, sf):
    w = T.SYMBOL.rowsBetween(1, 5)
    t = V.bars_b(spark, sf).withColumns({"k": F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol")), "c1": F.lead("close", 1).over(T.SYMBOL), "c5": F.lead("close", 5).over(T.SYMBOL), "hi": F.max("high").over(w), "lo": F.min("low").over(w)}).where("k <= 20")
    up = lambda c: C.ratio(c, "close") - 1
    return t.groupBy("trade_date").agg(F.count("*").alias("n"), F.round(F.avg(up("c1")), 5).alias("r1"), F.round(F.avg(up("c5")), 5).alias("r5"), F.round(F.max(up("hi")), 5).alias("best"), F.round(F.min(up("lo")), 5).alias("worst"))


@query("DOM_10_long_dataset", f"""{EVAL} SELECT feature, trade_date, symbol, round((rank() OVER (PARTITION BY feature, trade_date ORDER BY score) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY feature, trade_date) - 1, 0), 6) AS unit, round(fwd, 6) AS fwd FROM pairs""")
def long_dataset(spark, sf):
    pairs = scored(spark, sf).where("score IS NOT NULL AND fwd IS NOT NULL")
    return r(pairs, ["feature", "trade_date", "symbol"], unit=C.scaled_rank("score", "feature", "trade_date"), fwd=F.col("fwd"))


@query("DOM_16_exposures", f"""{B}, {RETS}, k AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY amount) + (count(*) OVER (PARTITION BY trade_date, amount) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0::DOUBLE AS v, rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0::DOUBLE AS c FROM rets),
u AS (SELECT trade_date, a, unnest([{{'f': 'volume', 'x': v}}, {{'f': 'close', 'x': c}}]) AS e FROM k), d AS (SELECT trade_date, e.f AS control, covar_pop(a, e.x) / nullif(stddev_pop(a) * stddev_pop(e.x), 0) AS c FROM u GROUP BY 1, 2 HAVING count(*) >= 5) SELECT control, round(avg(c), 5) AS exposure FROM d WHERE c IS NOT NULL GROUP BY 1""")
def exposures(spark, sf):
    long = E.stacked(rets(spark, sf), ["symbol", "trade_date", "amount"], ["volume", "close"]).withColumnRenamed("feature", "control")
    d = E.daily_ic(long, keys=("control",), score="score", ret="amount", least=5)
    return d.groupBy("control").agg(F.round(F.avg("rank_ic"), 5).alias("exposure"))


@query("DOM_18_model_comparison", f"""{B}, {RETS}, k AS (SELECT symbol, trade_date, lead(ret) {BY}) AS fwd, percent_rank() OVER (PARTITION BY trade_date ORDER BY amount) AS base, percent_rank() OVER (PARTITION BY trade_date ORDER BY volume) AS add FROM rets), m AS (SELECT trade_date, fwd, unnest([{{'m': 'BASELINE', 's': base}}, {{'m': 'SENTIMENT', 's': add}}, {{'m': 'BOTH', 's': 0.5 * base + 0.5 * add}}]) AS e FROM k WHERE fwd IS NOT NULL),
q AS (SELECT trade_date, e.m AS model, covar_pop(e.s, fwd) / nullif(stddev_pop(e.s) * stddev_pop(fwd), 0) AS ic FROM m GROUP BY 1, 2 HAVING count(*) >= 5) SELECT model, count(ic) AS days, round(avg(ic), 5) AS ic FROM q WHERE ic IS NOT NULL GROUP BY 1""")
def model_comparison(spark, sf):
    pr = lambda c: F.percent_rank().over(Window.partitionBy("trade_date").orderBy(c))
    k = rets(spark, sf).select("symbol", "trade_date", F.lead("ret").over(T.SYMBOL).alias("fwd"), pr("amount").alias("BASELINE"), pr("volume").alias("SENTIMENT"))
    long = E.stacked(k.withColumn("BOTH", F.col("BASELINE") * 0.5 + F.col("SENTIMENT") * 0.5), ["symbol", "trade_date", "fwd"], ["BASELINE", "SENTIMENT", "BOTH"]).withColumnRenamed("feature", "model")
    d = E.daily_ic(long, keys=("model",), ret="fwd", least=5)
    return d.groupBy("model").agg(F.count("ic").alias("days"), F.round(F.avg("ic"), 5).alias("ic"))


@query("DOM_23_feature_families", f"""{B}, {RETS}, c AS (SELECT abs(corr(amount, volume)) AS av FROM rets) SELECT 'amount' AS feature, 'amount' AS family UNION ALL SELECT 'volume', CASE WHEN av > 0.5 THEN 'amount' ELSE 'volume' END FROM c UNION ALL SELECT 'half_amount', 'amount'""")
def feature_families(spark, sf):
    shared.checkpoint_dir(spark)
    names = ["amount", "half_amount", "volume"]
    m = E.corr_matrix(rets(spark, sf).withColumn("half_amount", F.col("amount") / 2), names)
    edges = m.where("abs(pearson) > 0.5").select("a", "b")
    nodes = files.from_rows(spark, [(n,) for n in names], "node string")
    return E.components(edges, nodes).select(F.col("node").alias("feature"), F.col("component").alias("family"))


@query("DOM_24_baskets", f"""{B}, {RETS}, k AS (SELECT symbol, trade_date, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY ret ASC NULLS LAST) - 1)::DOUBLE / nullif(count(ret) OVER (PARTITION BY trade_date) - 1, 0) END AS a, (rank() OVER (PARTITION BY trade_date ORDER BY amount) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY trade_date) - 1, 0) AS b, (rank() OVER (PARTITION BY trade_date ORDER BY volume) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY trade_date) - 1, 0) AS c FROM rets)
SELECT symbol, trade_date, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 THEN round((coalesce(a, 0) + b + c) / ((a IS NOT NULL)::INT + 2), 6) END AS basket FROM k""")
def baskets(spark, sf):
    k = rets(spark, sf).withColumns({n: C.scaled_rank(c, "trade_date") for n, c in (("a", "ret"), ("b", "amount"), ("c", "volume"))})
    seen = sum((F.col(n).isNotNull().cast("int") for n in "abc"), F.lit(0))
    return r(k, ["symbol", "trade_date"], basket=F.when(seen >= 2, C.weighted_mean(*[(F.col(n), 1.0) for n in "abc"])))


@query("DOM_30_dynamic_weights", f"""{EVAL}, i AS (SELECT feature, avg(rank_ic) AS m FROM ic WHERE ic IS NOT NULL GROUP BY 1), w AS (SELECT feature, greatest(0.01, m) AS x FROM i), n AS (SELECT feature, x / sum(x) OVER () AS w FROM w), c AS (SELECT feature, least(0.6, greatest(0.2, w)) AS w FROM n) SELECT feature, round(w / sum(w) OVER (), 5) AS weight FROM c""")
def dynamic_weights(spark, sf):
    s = E.ic_summary(E.daily_ic(scored(spark, sf), ret="fwd", least=5))
    every = Window.partitionBy(F.lit(0))  # one row for each feature
    w = s.select("feature", F.greatest(F.lit(0.01), F.col("mean")).alias("x")).withColumn("w", F.col("x") / F.sum("x").over(every))
    w = w.withColumn("w", F.least(F.lit(0.6), F.greatest(F.lit(0.2), F.col("w"))))
    return r(w, ["feature"], 5, weight=F.col("w") / F.sum("w").over(every))


@query("DOM_43_research_table", f"""{A}, {V.SQL['statements']}, {PATH}, x AS (SELECT symbol, trade_date, (close - pc) / nullif(pc, 0) AS ret FROM path) SELECT x.symbol, x.trade_date, round(x.ret, 6) AS ret, round(s.profit / nullif(s.assets, 0), 6) AS roa, s.available AS known_on FROM x ASOF LEFT JOIN (SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY symbol, available ORDER BY period DESC) = 1) s ON x.symbol = s.symbol AND x.trade_date >= s.available""")
def research_table(spark, sf):
    x = T.path_features(V.bars_a(spark, sf)).select("symbol", "trade_date", "ret")
    j = pit.asof_join(x, V.statements(spark, sf), ["symbol"], "trade_date", "available", ["period"])
    return r(j, ["symbol", "trade_date"], ret=F.col("ret"), roa=C.ratio(F.col("asof.profit"), F.col("asof.assets"))).join(j.select("symbol", "trade_date", F.col("asof.available").alias("known_on")), ["symbol", "trade_date"])


@query("DOM_44_48_candidate_grid", f"""{B}, {RETS}, k AS (SELECT symbol, trade_date, lead(ret) {BY}) AS fwd, percent_rank() OVER (PARTITION BY trade_date ORDER BY amount) AS a, percent_rank() OVER (PARTITION BY trade_date ORDER BY volume) AS b FROM rets), g AS (SELECT w, trade_date, covar_pop(a * w / 4.0 + b * (1 - w / 4.0), fwd) / nullif(stddev_pop(a * w / 4.0 + b * (1 - w / 4.0)) * stddev_pop(fwd), 0) AS ic FROM k CROSS JOIN range(5) t(w) WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT 'S' || w AS candidate, round(avg(ic), 5) AS ic, row_number() OVER (ORDER BY round(avg(ic), 5) DESC, w) AS place FROM g WHERE ic IS NOT NULL GROUP BY w""")
def candidate_grid(spark, sf):
    pr = lambda c: F.percent_rank().over(Window.partitionBy("trade_date").orderBy(c))
    k = rets(spark, sf).select("symbol", "trade_date", F.lead("ret").over(T.SYMBOL).alias("fwd"), pr("amount").alias("a"), pr("volume").alias("b"))
    w = spark.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("candidate"), (F.col("id") / 4).alias("w"))
    long = k.crossJoin(F.broadcast(w)).withColumn("score", F.col("a") * F.col("w") + F.col("b") * (1 - F.col("w")))  # five candidates
    d = E.daily_ic(long, keys=("candidate",), ret="fwd", least=5).groupBy("candidate").agg(F.round(F.avg("ic"), 5).alias("ic"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ic"), "candidate")).cast("long"))


@query("DOM_67_emotion", f"""{B}, {RETS} SELECT trade_date, round(count(*) FILTER (WHERE volume >= 2)::DOUBLE / count(*), 6) AS fresh, count(*) FILTER (WHERE ret > 2) AS hot, count(*) FILTER (WHERE ret < -0.8) AS cold, count(*) FILTER (WHERE ret > 2 AND volume >= 2) AS confirmed FROM rets GROUP BY 1""")
def emotion(spark, sf):
    c = lambda e: F.count_if(F.expr(e))
    return rets(spark, sf).groupBy("trade_date").agg(F.round(c("volume >= 2") / F.count("*"), 6).alias("fresh"), c("ret > 2").alias("hot"), c("ret < -0.8").alias("cold"), c("ret > 2 AND volume >= 2").alias("confirmed"))


@query("DOM_74_tiers", f"""{B}, {RETS}, q AS (SELECT trade_date, quantile_cont(amount, 0.9) AS p90, quantile_cont(amount, 0.75) AS p75 FROM rets GROUP BY 1), x AS (SELECT trade_date, amount, lead(ret) {BY}) AS fwd FROM rets) SELECT CASE WHEN amount >= p90 THEN 'HIT' WHEN amount >= p75 THEN 'CRITICAL' ELSE 'CONTROL' END AS tier, count(fwd) AS n, round(avg(fwd), 5) AS mean, round(avg(fwd) / nullif(stddev_samp(fwd), 0) * sqrt(count(fwd)), 3) AS t FROM x JOIN q USING (trade_date) GROUP BY 1""")
def tiers(spark, sf):
    x = rets(spark, sf).withColumn("fwd", F.lead("ret").over(T.SYMBOL))
    q = x.groupBy("trade_date").agg(F.percentile("amount", F.lit(0.9)).alias("p90"), F.percentile("amount", F.lit(0.75)).alias("p75"))
    tier = F.when(F.col("amount") >= F.col("p90"), "HIT").when(F.col("amount") >= F.col("p75"), "CRITICAL").otherwise("CONTROL")
    g = x.join(F.broadcast(q), "trade_date").groupBy(tier.alias("tier"))  # a row for each day
    return g.agg(F.count("fwd").alias("n"), F.round(F.avg("fwd"), 5).alias("mean"), F.round(C.ratio(F.avg("fwd"), F.stddev_samp("fwd")) * F.sqrt(F.count("fwd").cast("double")), 3).alias("t"))


@query("DOM_78_replay_inputs", f"""{A}, k AS (SELECT symbol, trade_date, close, list(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS past, list(close) {BY} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS ahead FROM bars_a) SELECT symbol, trade_date, len(past) AS n_past, coalesce(len(ahead), 0) AS n_ahead, round(past[1], 8) AS oldest, round(ahead[-1], 8) AS newest FROM k""")
def replay_inputs(spark, sf):
    k = V.bars_a(spark, sf).withColumns({"past": T.history("close", T.SYMBOL, 60), "ahead": F.collect_list("close").over(T.SYMBOL.rowsBetween(1, 21))})
    last = F.when(F.size("ahead") > 0, F.element_at("ahead", -1))
    return k.select("symbol", "trade_date", F.size("past").cast("long").alias("n_past"), F.size("ahead").cast("long").alias("n_ahead"), F.round(F.element_at("past", 1), 8).alias("oldest"), F.round(last, 8).alias("newest"))
