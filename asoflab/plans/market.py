"""Queries of aggregates over markets, sectors, texts and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import evaluate as E
from asoflab.operators import market as M
from asoflab.operators import pit
from asoflab.operators import timeseries as T
from asoflab.plans.features import A, B, BY, PATH, RETS, r, rets
from asoflab.plans.registry import query
from asoflab.sources import views as V

ARETS = f"arets AS (SELECT symbol, trade_date, amount, (close - pc) / nullif(pc, 0) AS ret, (high - pc) / nullif(pc, 0) AS high_ret FROM path)"
BREADTH = """day AS (SELECT trade_date, count(*) AS members, count(ret) AS valid, count(*) FILTER (WHERE ret > 0) AS advancers, count(*) FILTER (WHERE ret < 0) AS decliners, count(*) FILTER (WHERE ret = 0) AS unchanged, avg(ret) AS mean_return, sum(amount) AS turnover FROM arets GROUP BY 1)"""


def arets(spark, sf) -> DataFrame:
    return T.path_features(V.bars_a(spark, sf)).select("symbol", "trade_date", "amount", "ret", C.change("high", "previous_close").alias("high_ret"))


REGIME = """reg AS (SELECT *, CASE WHEN count(mean_return) OVER w = 20 THEN sum(ln(greatest(1 + mean_return, 1e-8))) OVER w END AS log_sum, CASE WHEN count(mean_return) OVER w = 20 THEN stddev_samp(mean_return) OVER w END AS vol FROM day WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
regq AS (SELECT *, quantile_cont(vol, 0.75) OVER (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS vol_q75 FROM reg)"""
NAMED = "CASE WHEN vol IS NULL THEN 'UNKNOWN' WHEN vol > vol_q75 THEN 'HIGH_VOLATILITY' WHEN log_sum > 0.05 THEN 'TREND_UP' WHEN log_sum < -0.05 THEN 'TREND_DOWN' ELSE 'SIDEWAY' END"


@query("entry_breadth_regime", f"""{A}, {PATH}, {ARETS}, {BREADTH}, {REGIME} SELECT trade_date, valid, advancers, decliners, round(mean_return, 6) AS mean_return, round(vol, 5) AS vol, {NAMED} AS regime FROM regq""")
def breadth_regime(spark, sf):
    day = M.regime(M.market_breadth(arets(spark, sf)))
    return day.select("trade_date", "valid", "advancers", "decliners", F.round("mean_return", 6).alias("mean_return"), F.round("vol", 5).alias("vol"), "regime")


@query("AGG_2_breadth", f"""{A}, {PATH}, {ARETS}, {BREADTH} SELECT trade_date, members, valid, advancers, decliners, unchanged, round(advancers / nullif(valid, 0), 6) AS advance_ratio, round((advancers - decliners) / nullif(valid, 0), 6) AS strength, round(mean_return, 6) AS mean_return, round(turnover, 2) AS turnover,
round(valid / nullif(members, 0), 6) AS coverage, round((turnover - lag(turnover) OVER (ORDER BY trade_date)) / nullif(lag(turnover) OVER (ORDER BY trade_date), 0), 5) AS turnover_change FROM day""")
def breadth(spark, sf):
    d = M.market_breadth(arets(spark, sf))
    return d.select("trade_date", "members", "valid", "advancers", "decliners", "unchanged", *[F.round(c, k).alias(c) for c, k in (("advance_ratio", 6), ("strength", 6), ("mean_return", 6), ("turnover", 2), ("coverage", 6), ("turnover_change", 5))])


@query("AGG_3_limits", f"""{B}, p AS (SELECT *, lag(close) {BY}) AS pc FROM bars_b), x AS (SELECT symbol, trade_date, amount, (close - pc) / nullif(pc, 0) AS ret, (high - pc) / nullif(pc, 0) AS high_ret FROM p), n AS (SELECT *, row_number() {BY}) AS k, coalesce(ret >= 0.095, false) AS up FROM x),
s AS (SELECT *, k - coalesce(max(CASE WHEN NOT up THEN k END) {BY} ROWS UNBOUNDED PRECEDING), 0) AS streak FROM n), d AS (SELECT trade_date, count(*) FILTER (WHERE ret >= 0.095) AS limit_up, count(*) FILTER (WHERE ret <= -0.095) AS limit_down, count(*) FILTER (WHERE high_ret >= 0.095 AND NOT ret >= 0.095) AS broken, sum(amount) AS amount, sum(amount) FILTER (WHERE ret > 0) AS au, max(streak) AS longest FROM s GROUP BY 1)
SELECT trade_date, limit_up, limit_down, broken, longest, round(broken / nullif(broken + limit_up, 0), 6) AS broken_rate, round(au / nullif(amount, 0), 6) AS up_share, CASE WHEN count(amount) OVER w = 20 THEN round(amount / nullif(avg(amount) OVER w, 0), 6) END AS amount_ratio FROM d WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def limits(spark, sf):
    bars = T.path_features(V.bars_b(spark, sf)).withColumn("high_ret", C.change("high", "previous_close"))
    d = M.breadth_with_limits(T.with_streak(bars, F.col("ret") >= 0.095, "limit_streak"))
    return d.select("trade_date", "limit_up", "limit_down", "broken", F.col("longest"), *[F.round(c, 6).alias(c) for c in ("broken_rate", "up_share", "amount_ratio")])


@query("AGG_4_return_buckets", f"""{B}, {RETS} SELECT trade_date, count(*) FILTER (WHERE ret > 0.07) AS over7, count(*) FILTER (WHERE ret > 0.05 AND ret <= 0.07) AS b57, count(*) FILTER (WHERE ret > 0 AND ret <= 0.02) AS b02, count(*) FILTER (WHERE ret < 0) AS down, round(median(ret), 6) AS med, round(sum(amount) * 1000, 2) AS amount FROM rets GROUP BY 1""")
def return_buckets(spark, sf):
    c = lambda e: F.count_if(F.expr(e))
    return rets(spark, sf).groupBy("trade_date").agg(c("ret > 0.07").alias("over7"), c("ret > 0.05 AND ret <= 0.07").alias("b57"), c("ret > 0 AND ret <= 0.02").alias("b02"), c("ret < 0").alias("down"), F.round(F.percentile("ret", F.lit(0.5)), 6).alias("med"), F.round(F.sum("amount") * 1000, 2).alias("amount"))


@query("AGG_1_5_7_8_9_16_basics", """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, round(median(o_totalprice), 4) AS med, arg_max(o_orderkey, o_totalprice * 1e7 + o_orderkey) AS best, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, bool_or(o_totalprice > 400000) AS any_large, bool_and(o_totalprice > 10000) AS all_large, count(DISTINCT o_orderpriority) AS kinds, round(stddev_samp(o_totalprice), 3) AS sd, round(stddev_pop(o_totalprice), 3) AS sdp FROM orders GROUP BY 1""")
def basics(spark, sf):
    o = V.read(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.round(F.median("o_totalprice"), 4).alias("med"), F.max_by("o_orderkey", F.col("o_totalprice") * 1e7 + F.col("o_orderkey")).alias("best"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), F.bool_and(F.col("o_totalprice") > 10000).alias("all_large"), F.countDistinct("o_orderpriority").alias("kinds"), F.round(F.stddev_samp("o_totalprice"), 3).alias("sd"), F.round(F.stddev_pop("o_totalprice"), 3).alias("sdp"))


@query("AGG_6_history_arrays", f"""{A}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars_a) SELECT symbol, len(list(close)) AS n, round(list_sum(list(close)), 4) AS total, round(list(close ORDER BY trade_date)[1], 6) AS oldest, round(list(close ORDER BY trade_date)[-1], 6) AS newest FROM k WHERE k <= 61 GROUP BY 1""")
def history_arrays(spark, sf):
    rows = pit.last_rows(V.bars_a(spark, sf), ["symbol"], [F.desc("trade_date")], 61)
    arr = rows.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda x: x["close"]).alias("v"))
    return arr.select("symbol", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.element_at("v", 1), 6).alias("oldest"), F.round(F.element_at("v", -1), 6).alias("newest"))


@query("AGG_10_correlation", f"""{B} SELECT symbol, round(covar_pop(close, volume) / nullif(stddev_pop(close) * stddev_pop(volume), 0), 5) AS c FROM bars_b GROUP BY 1""")
def correlation(spark, sf):
    return V.bars_b(spark, sf).groupBy("symbol").agg(F.round(C.pearson("close", "volume"), 5).alias("c"))


@query("AGG_13_multi_grain", f"""{A}, {PATH}, {ARETS} SELECT 'FULL' AS grain, 'ALL' AS period, count(ret) AS n, round(avg(ret), 6) AS mean FROM arets UNION ALL SELECT 'YEAR', year(trade_date)::VARCHAR, count(ret), round(avg(ret), 6) FROM arets GROUP BY 2 UNION ALL SELECT 'QUARTER', year(trade_date) || 'Q' || quarter(trade_date), count(ret), round(avg(ret), 6) FROM arets GROUP BY 2""")
def multi_grain(spark, sf):
    x = arets(spark, sf).select("ret", F.year("trade_date").cast("string").alias("y"), F.concat(F.year("trade_date"), F.lit("Q"), F.quarter("trade_date")).alias("q"))
    g = x.groupingSets([[], [F.col("y")], [F.col("q")]], "y", "q").agg(F.grouping_id().alias("g"), F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean"))
    grain = F.when(F.col("g") == 3, "FULL").when(F.col("g") == 1, "YEAR").otherwise("QUARTER")
    return g.select(grain.alias("grain"), F.coalesce("y", "q", F.lit("ALL")).alias("period"), "n", "mean")


@query("AGG_14_fan_out", f"""{B}, {RETS}, x AS (SELECT trade_date, amount, unnest([{{'d': 'DIRECTION', 'v': CASE WHEN ret > 0 THEN 'UP' ELSE 'OTHER' END}}, {{'d': 'TURNOVER', 'v': CASE WHEN amount > 200 THEN 'HIGH' ELSE 'LOW' END}}]) AS e FROM rets) SELECT e.d AS dim, e.v AS value, count(*) AS n, round(avg(amount), 5) AS amount FROM x GROUP BY ALL""")
def fan_out(spark, sf):
    dims = F.array(F.struct(F.lit("DIRECTION").alias("dim"), F.when(F.col("ret") > 0, "UP").otherwise("OTHER").alias("value")), F.struct(F.lit("TURNOVER").alias("dim"), F.when(F.col("amount") > 200, "HIGH").otherwise("LOW").alias("value")))
    return rets(spark, sf).select("amount", F.explode(dims).alias("e")).groupBy("e.dim", "e.value").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 5).alias("amount"))


@query("AGG_15_slices", """WITH x AS (SELECT o_totalprice AS v, unnest([{'d': 'status', 'x': o_orderstatus}, {'d': 'priority', 'x': o_orderpriority}, {'d': 'year', 'x': year(o_orderdate)::VARCHAR}]) AS e FROM orders) SELECT e.d AS dim, e.x AS value, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(v), 4) END AS mean FROM x GROUP BY ALL""")
def slices(spark, sf):
    o = V.read(spark, sf, "orders")
    e = F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("value")) for d, c in (("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority")), ("year", F.year("o_orderdate").cast("string")))])
    g = o.select(F.col("o_totalprice").alias("v"), F.explode(e).alias("e")).groupBy("e.dim", "e.value").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    return g.select("dim", "value", "n", F.round(F.when(F.col("n") >= 30, F.col("m")), 4).alias("mean"))


@query("AGG_17_coverage", f"""{V.ctes('bars_a', 'industries')}, x AS (SELECT b.symbol, (b.volume > 25) AS ok, unnest([{{'s': 'overall', 'v': 'ALL'}}, {{'s': 'year', 'v': year(trade_date)::VARCHAR}}, {{'s': 'sector', 'v': sector}}]) AS e FROM bars_a b JOIN industries i USING (symbol)),
k AS (SELECT e.s AS slice, e.v AS value, symbol, count(*) AS n, count(*) FILTER (WHERE ok) AS ok FROM x GROUP BY ALL) SELECT slice, value, count(*) AS keys, count(*) FILTER (WHERE ok = n) AS "full", count(*) FILTER (WHERE ok > 0 AND ok < n) AS "partial", count(*) FILTER (WHERE ok = 0) AS missing, sum(n)::BIGINT AS rows, sum(ok)::BIGINT AS matched FROM k GROUP BY 1, 2""")
def coverage(spark, sf):
    rows = V.bars_a(spark, sf).join(V.industries(spark, sf), "symbol")
    return M.coverage(rows, {"overall": F.lit("ALL"), "year": F.year("trade_date"), "sector": F.col("sector")}, F.col("volume") > 25)


@query("AGG_18_history_coverage", f"""{V.ctes('bars_b', 'days_b')}, need AS (SELECT trade_date FROM days_b WHERE trade_index > (SELECT max(trade_index) FROM days_b) - 20), c AS (SELECT symbol, count(DISTINCT b.trade_date) FILTER (WHERE n.trade_date IS NOT NULL) AS seen FROM bars_b b LEFT JOIN need n USING (trade_date) GROUP BY 1) SELECT symbol, seen, seen = (SELECT count(*) FROM need) AS complete FROM c""")
def history_coverage(spark, sf):
    bars = V.bars_b(spark, sf)
    days = pit.trading_days(bars).withColumn("last", F.max("trade_index").over(Window.partitionBy(F.lit(0)))).select("trade_date", (F.col("trade_index") > F.col("last") - 20).alias("needed"))
    seen = bars.join(F.broadcast(days), "trade_date").groupBy("symbol").agg(F.countDistinct(F.when(F.col("needed"), F.col("trade_date"))).alias("seen"))
    need = days.agg(F.count_if("needed").alias("need"))
    return seen.crossJoin(F.broadcast(need)).select("symbol", "seen", (F.col("seen") == F.col("need")).alias("complete"))  # one row


@query("AGG_21_sectors", f"""{V.ctes('bars_a', 'industries')}, {PATH}, {ARETS}, {BREADTH}, s AS (SELECT a.*, sector, row_number() OVER (PARTITION BY trade_date, sector ORDER BY ret DESC NULLS LAST, symbol) AS k FROM arets a JOIN industries USING (symbol))
SELECT trade_date, sector, count(*) AS members, count(ret) AS observed, count(*) FILTER (WHERE ret > 0) AS advancers, round(avg(ret), 6) AS mean_return, round(median(ret), 6) AS median_return, max(CASE WHEN k = 1 AND ret IS NOT NULL THEN symbol END) AS leader, round(avg(CASE WHEN k <= 3 THEN ret END), 6) AS top_mean, round(avg(ret) - any_value(mean_return), 6) AS relative
FROM s JOIN day USING (trade_date) GROUP BY 1, 2""".replace("any_value(mean_return)", "any_value(day.mean_return)"))
def sectors(spark, sf):
    stock = arets(spark, sf)
    s = M.sector_snapshot(stock.join(V.industries(spark, sf).select("symbol", "sector"), "symbol"))
    return s.select("trade_date", "sector", "members", "observed", "advancers", "leader", *[F.round(c, 6).alias(c) for c in ("mean_return", "median_return", "top_mean", "relative")])


@query("AGG_22_sector_overview", f"""{V.ctes('bars_a', 'industries')}, {PATH}, {ARETS} SELECT industry, count(DISTINCT symbol) AS members, round(median(ret), 6) AS med, round(sum(amount), 2) AS amount FROM arets JOIN industries USING (symbol) GROUP BY 1""")
def sector_overview(spark, sf):
    x = arets(spark, sf).join(V.industries(spark, sf), "symbol")
    return x.groupBy("industry").agg(F.countDistinct("symbol").alias("members"), F.round(F.percentile("ret", F.lit(0.5)), 6).alias("med"), F.round(F.sum("amount"), 2).alias("amount"))


@query("AGG_23_24_concentration", f"""{B}, k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k FROM bars_b) SELECT trade_date, round(sum(amount), 2) AS total, round(sum(amount) FILTER (WHERE k <= 10) / nullif(sum(amount), 0), 6) AS top10_share, round(sum(amount) FILTER (WHERE k <= 50) / nullif(sum(amount), 0), 6) AS top50_share FROM k GROUP BY 1""")
def concentration(spark, sf):
    c = M.concentration(V.bars_b(spark, sf))
    return c.select("trade_date", F.round("total", 2).alias("total"), F.round("top10_share", 6).alias("top10_share"), F.round("top50_share", 6).alias("top50_share"))


@query("AGG_25_capital_flows", """WITH f AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END * l_extendedprice AS flow, n_regionkey AS sector FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT d, sector, symbol, sum(flow) AS net FROM f GROUP BY ALL), c AS (SELECT d, sector, sum(net) AS sector_net FROM s GROUP BY ALL), m AS (SELECT d, sum(net) AS market_net FROM s GROUP BY ALL) SELECT d, symbol, round(net, 2) AS net, round(net - sector_net, 2) AS to_sector, round(net - market_net, 2) AS to_market FROM s JOIN c USING (d, sector) JOIN m USING (d)""")
def capital_flows(spark, sf):
    line, supplier, nation = (V.read(spark, sf, n) for n in ("lineitem", "supplier", "nation"))
    f = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_extendedprice")).alias("flow"), F.col("n_regionkey").alias("sector"))
    s = f.groupBy("d", "sector", "symbol").agg(F.sum("flow").alias("net"))
    wide = s.withColumn("cn", F.sum("net").over(Window.partitionBy("d", "sector"))).withColumn("mn", F.sum("net").over(Window.partitionBy("d")))
    return wide.select("d", "symbol", F.round("net", 2).alias("net"), F.round(F.col("net") - F.col("cn"), 2).alias("to_sector"), F.round(F.col("net") - F.col("mn"), 2).alias("to_market"))


@query("AGG_26_margin", f"""{V.ctes('bars_b', 'days_b')}, m AS (SELECT symbol, trade_index, amount FROM bars_b JOIN days_b USING (trade_date) WHERE symbol % 4 <> 0), u AS (SELECT DISTINCT symbol FROM bars_b), d AS (SELECT max(trade_index) AS t FROM days_b) SELECT u.symbol, a.amount AS today, round(a.amount - b.amount, 2) AS change, round((a.amount - b.amount) / nullif(b.amount, 0), 6) AS change_pct, a.amount IS NOT NULL AS covered FROM u CROSS JOIN d LEFT JOIN m a ON a.symbol = u.symbol AND a.trade_index = d.t LEFT JOIN m b ON b.symbol = u.symbol AND b.trade_index = d.t - 1""")
def margin(spark, sf):
    bars = pit.with_trade_index(V.bars_b(spark, sf))
    last = pit.trading_days(V.bars_b(spark, sf)).agg(F.max("trade_index").alias("t"))
    m = bars.where("symbol % 4 <> 0").join(F.broadcast(last), F.col("trade_index").between(F.col("t") - 1, F.col("t")))
    both = m.groupBy("symbol").agg(F.max(F.when(F.col("trade_index") == F.col("t"), F.col("amount"))).alias("today"), F.max(F.when(F.col("trade_index") < F.col("t"), F.col("amount"))).alias("was"))
    u = bars.select("symbol").distinct().join(both, "symbol", "left")
    return u.select("symbol", "today", F.round(F.col("today") - F.col("was"), 2).alias("change"), F.round(C.change("today", "was"), 6).alias("change_pct"), F.col("today").isNotNull().alias("covered"))


@query("AGG_28_ladder", f"""{V.ctes('bars_b', 'days_b')}, p AS (SELECT *, lag(close) {BY}) AS pc FROM bars_b), n AS (SELECT symbol, trade_date, row_number() {BY}) AS k, coalesce(close > pc, false) AS up FROM p), s AS (SELECT symbol, trade_index, k - coalesce(max(CASE WHEN NOT up THEN k END) {BY} ROWS UNBOUNDED PRECEDING), 0) AS streak FROM n JOIN days_b USING (trade_date)),
d AS (SELECT trade_index, count(*) FILTER (WHERE streak = 1) AS first, count(*) FILTER (WHERE streak >= 4) AS fourth_up, max(streak) AS height, count(*) AS held, count(*) FILTER (WHERE streak > 1) AS promoted FROM s WHERE streak > 0 GROUP BY 1) SELECT a.trade_index, a.first, a.fourth_up, a.height, round(a.promoted / nullif(b.held, 0), 6) AS promotion_rate FROM d a LEFT JOIN d b ON b.trade_index = a.trade_index - 1""")
def ladder(spark, sf):
    bars = V.bars_b(spark, sf).withColumn("pc", F.lag("close").over(T.SYMBOL))
    s = pit.with_trade_index(T.with_streak(bars, F.col("close") > F.col("pc"), "streak"))
    l = M.ladder(s)
    return l.select(F.col("trade_index").cast("long").alias("trade_index"), "first", "fourth_up", "height", F.round("promotion_rate", 6).alias("promotion_rate"))


@query("AGG_29_return_stats", f"""{B}, {RETS} SELECT symbol % 10 AS grp, count(ret) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS "median", round(count(*) FILTER (WHERE ret > 0) / nullif(count(ret), 0), 6) AS win_rate, round(sum(ret) FILTER (WHERE ret > 0) / nullif(-sum(ret) FILTER (WHERE ret < 0), 0), 5) AS profit_factor FROM rets GROUP BY 1""")
def return_stats(spark, sf):
    g = rets(spark, sf).groupBy((F.col("symbol") % 10).alias("grp")).agg(*M.return_stats())
    return g.select("grp", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 5).alias("profit_factor"))


@query("AGG_30_compounding", f"""{A}, {PATH}, {ARETS}, {BREADTH} SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, round(exp(sum(ln(greatest(1 + mean_return / 100, 1e-8)))) - 1, 6) AS ret, avg((mean_return > 0)::INT::DOUBLE) AS positive FROM day WHERE mean_return IS NOT NULL GROUP BY 1""".replace("avg((mean_return > 0)::INT::DOUBLE)", "round(avg((mean_return > 0)::INT::DOUBLE), 6)"))
def compounding(spark, sf):
    d = M.market_breadth(arets(spark, sf)).where("mean_return IS NOT NULL")
    return d.groupBy(F.to_date(F.date_trunc("month", "trade_date")).alias("month")).agg(F.round(F.exp(F.sum(F.ln(F.greatest(1 + F.col("mean_return") / 100, F.lit(1e-8))))) - 1, 6).alias("ret"), F.round(F.avg((F.col("mean_return") > 0).cast("double")), 6).alias("positive"))


@query("AGG_32_distribution", f"""{B}, {RETS}, k AS (SELECT ret, row_number() OVER (ORDER BY ret DESC, symbol, trade_date) AS k, count(*) OVER () AS n FROM rets WHERE ret IS NOT NULL) SELECT round(quantile_cont(ret, 0.1), 6) AS p10, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.9), 6) AS p90, round(min(ret), 6) AS low, round(max(ret), 6) AS high, round(sum(ret) FILTER (WHERE k <= n * 0.01) / sum(ret), 5) AS top1_share, round(avg(ret) FILTER (WHERE k > n * 0.05), 6) AS mean_without5 FROM k""")
def distribution(spark, sf):
    x = rets(spark, sf).where("ret IS NOT NULL")
    n = x.count()
    cuts = E.tail_sums(x, "ret", [int(n * 0.01), int(n * 0.05)])  # sums of the largest 1 % and 5 %, one row
    t = x.agg(*[F.percentile("ret", F.lit(q)).alias(c) for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))], F.min("ret").alias("low"), F.max("ret").alias("high"), F.sum("ret").alias("total"), F.count("*").alias("n"))
    return t.select(*[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "low", "high")], F.round(F.lit(cuts[0]) / F.col("total"), 5).alias("top1_share"), F.round((F.col("total") - cuts[1]) / (F.col("n") - int(n * 0.05)), 6).alias("mean_without5"))


@query("AGG_34_json_arrays", """WITH e AS (SELECT event_type, 'a' || (json_extract_string(props, '$.k')::INTEGER % 3) || ',b' || (user_id % 2) AS tags FROM events), x AS (SELECT unnest(string_split(tags, ',')) AS tag FROM e) SELECT tag, count(*) AS n FROM x GROUP BY 1""")
def json_arrays(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    packed = F.to_json(F.array(F.concat(F.lit("a"), (k % 3).cast("string")), F.concat(F.lit("b"), (F.col("user_id") % 2).cast("string"))))
    return V.read(spark, sf, "events").select(F.explode(F.from_json(packed, "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("AGG_35_divergence_stats", """SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(avg((value > 50)::INT::DOUBLE), 6) AS rate FROM events GROUP BY 1""")
def divergence_stats(spark, sf):
    return V.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.round(F.percentile("value", F.lit(0.5)), 5).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 5).alias("p95"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))


@query("AGG_38_word_frequency", r"""WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS token FROM conversations) SELECT token, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 5""")
def word_frequency(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    return V.read(spark, sf, "conversations").select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 5")


@query("AGG_39_stances", """WITH s AS (SELECT source, sum((toxic = 0 AND quality = 1)::INT) AS p, sum((toxic = 1)::INT) AS n, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, p::BIGINT AS positive, n::BIGINT AS negative, round(1 - abs(p - n)::DOUBLE / nullif(p + n, 0), 6) AS divergence, round(ln(1 + c) * (1 + (1 - abs(p - n)::DOUBLE / nullif(p + n, 0))), 5) AS heat FROM s""")
def stances(spark, sf):
    j = V.read(spark, sf, "documents").select("doc_id", "source").join(V.read(spark, sf, "labels"), "doc_id")
    s = j.groupBy("source").agg(F.count_if(F.expr("toxic = 0 AND quality = 1")).alias("positive"), F.count_if(F.expr("toxic = 1")).alias("negative"), F.count("*").alias("c"))
    d = 1 - C.ratio(F.abs(F.col("positive") - F.col("negative")).cast("double"), F.col("positive") + F.col("negative"))
    return s.select("source", "positive", "negative", F.round(d, 6).alias("divergence"), F.round(F.log1p(F.col("c").cast("double")) * (1 + d), 5).alias("heat"))


@query("AGG_40_news_window", """SELECT source, count(*) AS raw, count(DISTINCT md5(text)) AS "unique", count(*) - count(DISTINCT md5(text)) AS duplicates, min(n_chars) AS shortest, round(median(n_chars), 2) AS med, max(n_chars) AS longest FROM documents GROUP BY 1""")
def news_window(spark, sf):
    return V.read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("raw"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("unique"), (F.count("*") - F.countDistinct(F.md5(F.col("text").cast("binary")))).alias("duplicates"), F.min("n_chars").alias("shortest"), F.round(F.percentile("n_chars", F.lit(0.5)), 2).alias("med"), F.max("n_chars").alias("longest"))


@query("AGG_42_decayed_sentiment", """SELECT user_id AS asset, round(sum(exp(-ln(2) * (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts))) / 86400 / 7) * (value - 50)) / nullif(sum(exp(-ln(2) * (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts))) / 86400 / 7)), 0), 5) AS sentiment, count(*) AS n FROM events GROUP BY 1""")
def decayed_sentiment(spark, sf):
    age = (F.unix_timestamp(F.to_timestamp(F.lit("2024-02-01"))) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400
    w = F.exp(-F.ln(F.lit(2.0)) * age / 7)
    return V.read(spark, sf, "events").withColumn("w", w).groupBy(F.col("user_id").alias("asset")).agg(F.round(C.ratio(F.sum(F.col("w") * (F.col("value") - 50)), F.sum("w")), 5).alias("sentiment"), F.count("*").alias("n"))


@query("AGG_45_cumulative_net", f"""{A} SELECT symbol, trade_date, CASE WHEN count(*) {BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN round(sum(amount) {BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) END AS net5, CASE WHEN count(*) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN round(sum(amount) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 2) END AS net20 FROM bars_a""")
def cumulative_net(spark, sf):
    net = lambda n: C.full(F.sum("amount").over(C.trailing(T.SYMBOL, n)), F.col("amount"), C.trailing(T.SYMBOL, n), n)
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], 2, net5=net(5), net20=net(20))


@query("AGG_48_availability", f"""{V.ctes('bars_a', 'statements')}, b AS (SELECT symbol, count(*) AS n FROM bars_a GROUP BY 1), s AS (SELECT symbol, count(*) AS m FROM statements GROUP BY 1) SELECT symbol, array_to_string(list_filter([CASE WHEN n >= 60 THEN 'bars' END, CASE WHEN m >= 4 THEN 'statements' END], lambda x: x IS NOT NULL), ',') AS available FROM b LEFT JOIN s USING (symbol)""")
def availability(spark, sf):
    b = V.bars_a(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    s = V.statements(spark, sf).groupBy("symbol").agg(F.count("*").alias("m"))
    return b.join(s, "symbol", "left").select("symbol", F.array_join(C.flags(bars=F.col("n") >= 60, statements=F.col("m") >= 4), ",").alias("available"))
