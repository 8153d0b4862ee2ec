"""Queries of replay inputs, aligned packets and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import pit
from asoflab.operators import replay as P
from asoflab.plans.features import r
from asoflab.plans.registry import query
from asoflab.sources import views as V

#: Statements, statuses and industries of the eight suppliers' desk that a bar belongs to; customers fall to desks in the same proportion.
SIDES_SQL = """filed AS (SELECT o_custkey // 120 AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS revenue, CAST(max(o_orderdate) AS DATE) + 10 AS available FROM orders GROUP BY 1, 2),
stated AS (SELECT o_custkey // 120 AS symbol, CAST(o_orderdate AS DATE) AS since, o_orderkey AS status_id, o_orderstatus AS status FROM orders),
member AS (SELECT o_custkey // 120 AS symbol, CAST(date_trunc('year', o_orderdate) AS DATE) AS since, 'I' || (sum(o_orderkey)::BIGINT % 5) AS industry FROM orders GROUP BY 1, 2)"""

_LAST = lambda table, columns, time, order: f"(SELECT symbol, {time} AS t, {columns} FROM {table} QUALIFY row_number() OVER (PARTITION BY symbol, {time} ORDER BY {order}) = 1)"


def sides(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = V.read(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 120).alias("symbol"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus", "o_totalprice")
    filed = o.groupBy("symbol", F.to_date(F.trunc("day", "month")).alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.date_add(F.max("day"), 10).alias("available"))
    stated = o.select("symbol", F.col("day").alias("since"), F.col("o_orderkey").alias("status_id"), F.col("o_orderstatus").alias("status"))
    member = o.groupBy("symbol", F.to_date(F.trunc("day", "year")).alias("since")).agg(F.concat(F.lit("I"), (F.sum("o_orderkey") % 5).cast("string")).alias("industry"))
    return filed, stated, member


_SUM = "round(list_sum(list_transform(coalesce({x}, []), lambda b: b.c)), 2)"


@query("DOM_78_replay_rows", f"""{V.ctes('bars_c', 'days_c')}, {SIDES_SQL}, grid AS (SELECT s.symbol, d.trade_date, d.trade_index, b.close, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY d.trade_index) AS filled FROM (SELECT DISTINCT symbol FROM bars_c) s CROSS JOIN days_c d LEFT JOIN bars_c b USING (symbol, trade_date)),
ahead AS (SELECT symbol, trade_date, trade_index, close, list({{'d': trade_date, 'c': filled, 's': close IS NULL}}) OVER (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS f FROM grid),
seen AS (SELECT *, list({{'d': trade_date, 'c': close}}) OVER (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS h FROM ahead WHERE close IS NOT NULL),
market AS (SELECT trade_index, avg(close) AS level FROM bars_c JOIN days_c USING (trade_date) GROUP BY 1), coming AS (SELECT trade_index, max(level) OVER (ORDER BY trade_index RANGE BETWEEN 20 FOLLOWING AND 20 FOLLOWING) / nullif(level, 0) - 1 AS benchmark FROM market),
placed AS (SELECT b.symbol, trade_index, close, industry FROM (SELECT * FROM bars_c JOIN days_c USING (trade_date)) b ASOF LEFT JOIN {_LAST('member', 'industry', 'since', 'since')} m ON b.symbol = m.symbol AND b.trade_date >= m.t),
levels AS (SELECT industry, trade_index, avg(close) AS level FROM placed GROUP BY 1, 2), moving AS (SELECT industry, trade_index, max(level) OVER (PARTITION BY industry ORDER BY trade_index RANGE BETWEEN 20 FOLLOWING AND 20 FOLLOWING) / nullif(level, 0) - 1 AS industry_return FROM levels)
SELECT x.symbol, x.trade_date, len(h) AS n_history, h[1].d AS history_from, {_SUM.format(x='h')} AS history_sum, len(coalesce(f, [])) AS n_ahead, len(list_filter(coalesce(f, []), lambda b: b.s)) AS n_suspended, {_SUM.format(x='f')} AS ahead_sum, f[-1].d AS ahead_to,
  s.period AS statement_period, s.revenue, t.status, m.industry, round(benchmark, 6) AS benchmark, round(industry_return, 6) AS industry_return
FROM seen x ASOF LEFT JOIN {_LAST('filed', 'period, revenue', 'available', 'period DESC')} s ON x.symbol = s.symbol AND x.trade_date >= s.t ASOF LEFT JOIN {_LAST('stated', 'status', 'since', 'status_id DESC')} t ON x.symbol = t.symbol AND x.trade_date >= t.t
ASOF LEFT JOIN {_LAST('member', 'industry', 'since', 'since')} m ON x.symbol = m.symbol AND x.trade_date >= m.t LEFT JOIN coming USING (trade_index) LEFT JOIN moving v ON v.industry IS NOT DISTINCT FROM m.industry AND v.trade_index = x.trade_index""")
def replay_rows(spark, sf):
    rows = replayed(spark, sf)
    total = lambda c: F.when(F.size(c) > 0, F.round(F.aggregate(c, F.lit(0.0), lambda s, b: s + b["close"]), 2))
    return rows.select(
        "symbol", "trade_date", F.size("history").cast("long").alias("n_history"), F.col("history")[0]["trade_date"].alias("history_from"), total("history").alias("history_sum"), F.size("ahead").cast("long").alias("n_ahead"),
        F.size(F.filter("ahead", lambda b: b["suspended"])).cast("long").alias("n_suspended"), total("ahead").alias("ahead_sum"), F.get("ahead", F.size("ahead") - 1)["trade_date"].alias("ahead_to"),
        F.col("statement.period").alias("statement_period"), F.col("statement.revenue").alias("revenue"), F.col("state.status").alias("status"), "industry", F.round("benchmark", 6).alias("benchmark"), F.round("industry_return", 6).alias("industry_return"),
    )


def replayed(spark, sf) -> DataFrame:
    bars = V.bars_c(spark, sf)
    days = pit.trading_days(V.dates_a(spark, sf)).select("trade_date", "trade_index")
    filed, stated, member = sides(spark, sf)
    grid = pit.dense_grid(bars.select("symbol").distinct(), days, bars).select("symbol", "trade_date", "trade_index", "open", "high", "low", "close")
    rights = {"statement": (filed, "available", ["period"]), "state": (stated, "since", ["status_id"]), "membership": (member, "since", [])}
    rows = P.replay_inputs(grid, rights).withColumn("industry", F.col("membership.industry"))
    placed = P.asof_many(pit.with_trade_index(bars, days), {"membership": rights["membership"]}, "symbol", "trade_date").withColumn("industry", F.col("membership.industry"))
    market = placed.groupBy("trade_index").agg(F.avg("close").alias("level"))
    levels = placed.where("industry IS NOT NULL").groupBy("industry", "trade_index").agg(F.avg("close").alias("level"))
    return P.with_returns(P.with_returns(rows, market, "benchmark", 20), levels, "industry_return", 20, ["industry"])


@query("DOM_43_aligned_packets", f"""{V.ctes('bars_c', 'days_c')}, {SIDES_SQL}, x AS (SELECT symbol, trade_date, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / nullif(avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) - 1 AS technical FROM bars_c WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
packets AS (SELECT l_suppkey // 8 AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) + 7 AS known, round(avg(CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END), 6) AS sentiment FROM lineitem GROUP BY 1, 2)
SELECT x.symbol, x.trade_date, round(ret, 6) AS ret, round(technical, 6) AS technical, s.period AS statement_period, s.revenue, t.status, k.sentiment, k.t AS sentiment_known, (technical IS NOT NULL)::INT + (s.revenue IS NOT NULL)::INT + (k.sentiment IS NOT NULL)::INT AS available
FROM x ASOF LEFT JOIN {_LAST('filed', 'period, revenue', 'available', 'period DESC')} s ON x.symbol = s.symbol AND x.trade_date >= s.t ASOF LEFT JOIN {_LAST('stated', 'status', 'since', 'status_id DESC')} t ON x.symbol = t.symbol AND x.trade_date >= t.t ASOF LEFT JOIN {_LAST('packets', 'sentiment', 'known', 'known')} k ON x.symbol = k.symbol AND x.trade_date >= k.t""")
def aligned_packets(spark, sf):
    filed, stated, _ = sides(spark, sf)
    tone = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    packets = V.read(spark, sf, "lineitem").groupBy(F.floor(F.col("l_suppkey") / 8).alias("symbol"), F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 7).alias("known")).agg(F.round(F.avg(tone), 6).alias("sentiment"))
    rights = {"statement": (filed, "available", ["period"]), "state": (stated, "since", ["status_id"]), "packet": (packets, "known", [])}
    by = Window.partitionBy("symbol").orderBy("trade_date")
    own = {"ret": C.ratio("close", F.lag("close").over(by)) - 1, "technical": C.ratio("close", F.avg("close").over(by.rowsBetween(-19, 0))) - 1}
    x = P.asof_many(V.bars_c(spark, sf).select("symbol", "trade_date", "close"), rights, "symbol", "trade_date", own)
    there = sum((F.col(c).isNotNull().cast("int") for c in ("technical", "statement.revenue", "packet.sentiment")), F.lit(0))
    return x.select("symbol", "trade_date", F.round("ret", 6).alias("ret"), F.round("technical", 6).alias("technical"), F.col("statement.period").alias("statement_period"), "statement.revenue", "state.status", "packet.sentiment", F.col("packet.known").alias("sentiment_known"), there.alias("available"))


#: 38 features, each of two of the 99 sources.
REGISTRY_SQL = "registry AS (SELECT DISTINCT 'F' || f AS feature, unnest([(f * 7) % 99, (f * 11 + 3) % 99]) AS source FROM range(38) t(f))"


@query("DOM_64_readiness", f"""{V.ctes('bars_c', 'days_c')}, {REGISTRY_SQL}, complete AS (SELECT DISTINCT CAST(round(l_discount * 100) * 9 + round(l_tax * 100) AS BIGINT) AS source, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem),
asked AS (SELECT feature, source, trade_date FROM registry CROSS JOIN days_c), lacking AS (SELECT feature, trade_date FROM asked ANTI JOIN complete USING (source, trade_date) GROUP BY ALL), listed AS (SELECT feature, count(*) AS n, string_agg(trade_date::VARCHAR, ',' ORDER BY trade_date) AS dates FROM lacking GROUP BY 1)
SELECT feature, count(*) AS sources, (SELECT count(*) FROM days_c) AS required, (SELECT count(*) FROM days_c) - coalesce(any_value(n), 0) AS covered, coalesce(any_value(n), 0) = 0 AS ready, sha256(coalesce(any_value(dates), '')) AS missing_sha256 FROM registry LEFT JOIN listed USING (feature) GROUP BY feature""")
def readiness(spark, sf):
    rows = V.read(spark, sf, "lineitem").select((F.round(F.col("l_discount") * 100) * 9 + F.round(F.col("l_tax") * 100)).cast("long").alias("source"), F.to_date("l_shipdate").alias("trade_date"))
    days = pit.trading_days(rows).select("trade_date", "trade_index")
    f = spark.range(38)
    registry = f.select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("feature"), F.explode(F.array(F.col("id") * 7 % 99, (F.col("id") * 11 + 3) % 99)).alias("source"))
    told = P.readiness(registry, rows.join(F.broadcast(days), "trade_date").select("source", "trade_index"), days)
    dates = F.array_join(F.transform("missing", lambda d: d.cast("string")), ",")
    return told.select("feature", "sources", "required", "covered", "ready", F.sha2(dates, 256).alias("missing_sha256"))


@query("AGG_18_coverage_windows", f"""{V.ctes('bars_a', 'days_a')}, p AS (SELECT symbol, (SELECT max(trade_index) FROM days_a) - trade_index + 1 AS back FROM bars_a JOIN days_a USING (trade_date)), c AS (SELECT symbol, count(*) FILTER (back <= 20) AS seen_20, count(*) FILTER (back <= 60) AS seen_60, max(back) AS sessions, count(*) FILTER (back <= 30) AS alive FROM p GROUP BY 1)
SELECT symbol, seen_20, seen_60, seen_20 = 20 AS complete_20, seen_60 = 60 AS complete_60, sessions, sessions < 60 AS is_new, alive = 0 AS long_suspended FROM c""")
def coverage_windows(spark, sf):
    bars = V.bars_a(spark, sf)
    return P.window_coverage(bars, pit.trading_days(bars).select("trade_date", "trade_index"), (20, 60), 30)
