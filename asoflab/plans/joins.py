"""Queries of sources, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.functions import filters as X
from asoflab.operators import landing, pit
from asoflab.operators import timeseries as T
from asoflab.plans.features import A, B, BY, RETS, rets
from asoflab.plans.registry import query
from asoflab.sources import views as V


@query("SRC_1_scan", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_returnflag = 'R' GROUP BY 1")
def scan(spark, sf):
    return V.read(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02' AND l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SRC_4_payload", """SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS INTEGER)) AS known, sum(try_cast(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS total FROM events GROUP BY 1""")
def payload(spark, sf):
    k = landing.extracted("props", {"k": ("$.k", "int")})["k"]
    return V.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("known"), F.sum(k).alias("total"))


@query("SRC_5_fallback", f"""{V.ctes('bars_a', 'bars_b')}, n AS (SELECT symbol, trade_date, close FROM bars_a WHERE symbol % 2 = 0), o AS (SELECT symbol, trade_date, close * 2 AS close FROM bars_a)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE (symbol, trade_date) NOT IN (SELECT symbol, trade_date FROM n)""")
def fallback(spark, sf):
    bars = V.bars_a(spark, sf).select("symbol", "trade_date", "close")
    return pit.prefer_with_fallback(bars.where("symbol % 2 = 0"), bars.withColumn("close", F.col("close") * 2), ["symbol", "trade_date"])


@query("SRC_8_landing", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) AS k FROM lineitem)
SELECT CASE WHEN l_suppkey % 10 = 9 THEN 'INVALID_SYMBOL' WHEN l_extendedprice IS NULL OR l_quantity IS NULL THEN 'INVALID_NUMBER' WHEN l_discount > l_tax + 0.09 THEN 'INVALID_OHLC' WHEN k > 1 THEN 'DUPLICATE_SYMBOL' ELSE 'OK' END AS error_code, count(*) AS n FROM x GROUP BY 1""")
def landing_counts(spark, sf):
    rows = V.read(spark, sf, "lineitem")
    checks = {"INVALID_SYMBOL": F.col("l_suppkey") % 10 == 9, "INVALID_NUMBER": F.col("l_extendedprice").isNull() | F.col("l_quantity").isNull(), "INVALID_OHLC": F.col("l_discount") > F.col("l_tax") + 0.09}
    coded = landing.coded(rows, checks, ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_extendedprice")])
    return coded.groupBy(F.coalesce("error_code", F.lit("OK")).alias("error_code")).agg(F.count("*").alias("n"))


@query("SRC_9_comments", """WITH x AS (SELECT doc_id, text, md5(text) AS h FROM documents), y AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM x)
SELECT CASE WHEN text IS NULL OR length(text) < 4 THEN 'TOO_SHORT' WHEN contains(text, '@') THEN 'PII' WHEN k > 1 THEN 'DUPLICATE' ELSE 'OK' END AS error_code, count(*) AS n FROM y GROUP BY 1""")
def comments(spark, sf):
    docs = V.read(spark, sf, "documents").select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("h"))
    checks = {"TOO_SHORT": F.col("text").isNull() | (F.length("text") < 4), "PII": F.col("text").contains("@")}
    coded = landing.coded(docs, checks, ["h"], [F.asc("doc_id")], "DUPLICATE")
    return coded.groupBy(F.coalesce("error_code", F.lit("OK")).alias("error_code")).agg(F.count("*").alias("n"))


@query("SNK_1_append_new", f"""{A} SELECT symbol, trade_date FROM bars_a WHERE NOT (symbol % 2 = 0)""")
def append_new(spark, sf):
    bars = V.bars_a(spark, sf).select("symbol", "trade_date")
    return pit.append_new(bars, bars.where("symbol % 2 = 0"), ["symbol", "trade_date"])


@query("SNK_2_merge_by_hash", f"""{A}, n AS (SELECT symbol, trade_date, close, CASE WHEN symbol % 3 = 0 THEN 'a' ELSE 'b' END AS h FROM bars_a WHERE trade_date >= DATE '1999-01-01'), o AS (SELECT symbol, trade_date, close - 1 AS close, 'a' AS h FROM bars_a WHERE trade_date < DATE '2000-01-01')
SELECT CASE WHEN n.symbol IS NULL THEN 'KEPT' WHEN o.symbol IS NULL THEN 'NEW' WHEN n.h = o.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS state, count(*) AS n, round(sum(CASE WHEN o.symbol IS NULL OR n.h <> o.h THEN n.close ELSE o.close END), 4) AS close
FROM n FULL JOIN o ON n.symbol = o.symbol AND n.trade_date = o.trade_date GROUP BY 1""")
def merge_by_hash(spark, sf):
    bars = V.bars_a(spark, sf)
    new = bars.where("trade_date >= '1999-01-01'").select("symbol", "trade_date", "close", F.when(F.col("symbol") % 3 == 0, "a").otherwise("b").alias("h"))
    old = bars.where("trade_date < '2000-01-01'").select("symbol", "trade_date", (F.col("close") - 1).alias("close"), F.lit("a").alias("h"))
    return pit.merge_by_hash(new, old, ["symbol", "trade_date"], "h").groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("close"))


@query("SNK_3_last_write", """WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM u WHERE k = 1""")
def last_write(spark, sf):
    orders = V.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    one = lambda d: pit.latest_revision(d, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    old, new = one(orders.where("o_orderkey % 2 = 0")), one(orders.where("o_orderkey % 2 = 1"))
    both = old.unionByName(new)
    return one(both).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SNK_4_same_values", f"""{A} SELECT count(*) FILTER (WHERE abs(close - round(close, 6)) <= greatest(1e-6, 1e-9 * greatest(abs(close), abs(round(close, 6))))) AS same6, count(*) FILTER (WHERE abs(close - round(close, 1)) <= greatest(1e-2, 1e-9 * greatest(abs(close), abs(round(close, 1))))) AS same1, count(*) AS n FROM bars_a""")
def same_values(spark, sf):
    near = lambda digits, tol: C.close_enough("close", F.round("close", digits), tol)
    return V.bars_a(spark, sf).agg(F.count_if(near(6, 1e-6)).alias("same6"), F.count_if(near(1, 1e-2)).alias("same1"), F.count("*").alias("n"))


@query("SNK_6_pending_dates", f"""{V.ctes('bars_b', 'days_b')} SELECT trade_date FROM days_b WHERE trade_index % 3 <> 0 OR trade_index = 6""")
def pending_dates(spark, sf):
    days = pit.trading_days(V.bars_b(spark, sf)).select("trade_date", "trade_index")
    done = days.where("trade_index % 3 = 0 AND trade_index <> 6").select("trade_date", F.lit("COMPLETE").alias("status"))
    return pit.pending_dates(days.select("trade_date"), done)


@query("SNK_10_retention", """SELECT source, count(*) AS n FROM documents WHERE CASE source WHEN 'src0' THEN true WHEN 'src1' THEN DATE '2024-01-01' + (doc_id % 60)::INTEGER >= DATE '2024-01-21' ELSE DATE '2024-01-01' + (doc_id % 60)::INTEGER >= DATE '2024-02-10' END GROUP BY 1""")
def retention(spark, sf):
    docs = V.read(spark, sf, "documents").select("doc_id", "source", F.col("source").alias("source_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("fetched_on"))
    sources = docs.select("source_id").distinct().withColumn("ttl_days", F.when(F.col("source_id") == "src0", 0).when(F.col("source_id") == "src1", 40).otherwise(20))
    return pit.retained(docs, sources, F.lit("2024-03-01").cast("date")).groupBy("source").agg(F.count("*").alias("n"))


@query("SNK_11_lineage", f"""{A}, h AS (SELECT trade_date, sha256(concat_ws('|', symbol::VARCHAR, coalesce(strftime(trade_date, '%Y-%m-%d'), 'NULL'), coalesce(CAST(round(volume) AS BIGINT)::VARCHAR, 'NULL'))) AS h FROM bars_a)
SELECT trade_date, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM h GROUP BY 1""")
def lineage(spark, sf):
    rows = V.bars_a(spark, sf).select("trade_date", C.row_hash("symbol", "trade_date", F.round("volume").cast("long")).alias("h"))
    return rows.groupBy("trade_date").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"), F.count("*").alias("n"))


# Filters

PLAN = [X.Node("GT", "p_size", 10), X.Node("RANGE", "p_retailprice", (900.5, 901.5), (True, False)), X.Node("NOT_IN", "p_type", ["ECONOMY"])]


@query("FLT_1_to_6_filters", """SELECT p_partkey FROM part WHERE p_size > 10 AND (p_retailprice >= 900.5 AND p_retailprice < 901.5 OR p_brand IN ('Brand#1', 'Brand#2')) AND p_type <> 'ECONOMY'""")
def filters(spark, sf):
    tree = X.Node("AND", children=[PLAN[0], X.Node("OR", children=[PLAN[1], X.Node("IN", "p_brand", ["Brand#1", "Brand#2"])]), PLAN[2]])
    return X.applied(V.read(spark, sf, "part"), [tree]).select("p_partkey")


@query("FLT_7_missing_summary", """WITH p AS (SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS s FROM part) SELECT count(*) AS seen_0, count(*) FILTER (WHERE s IS NULL) AS missing_0, count(*) FILTER (WHERE s > 10) AS kept_0, count(*) FILTER (WHERE s > 10) AS seen_1,
count(*) FILTER (WHERE s > 10 AND p_retailprice IS NULL) AS missing_1, count(*) FILTER (WHERE s > 10 AND p_retailprice >= 900.5 AND p_retailprice < 901.5) AS kept_1 FROM p""")
def missing_summary(spark, sf):
    part = V.read(spark, sf, "part").withColumn("p_size", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")))
    return X.missing_summary(part, PLAN[:2])


@query("FLT_8_9_layers", """SELECT CASE WHEN p_size > 10 AND p_retailprice >= 900 AND p_retailprice <= 950 THEN 'CORE' WHEN (p_size <= 10 AND abs(p_size - 10) <= 1.0 AND p_retailprice >= 900 AND p_retailprice <= 950) OR (p_size > 10 AND p_retailprice > 950 AND p_retailprice <= 955) OR (p_size > 10 AND p_retailprice < 900 AND p_retailprice >= 895) THEN 'NEAR' ELSE 'CONTROL' END AS layer, count(*) AS n FROM part GROUP BY 1""")
def layers(spark, sf):
    tree = X.Node("AND", children=[X.Node("GT", "p_size", 10), X.Node("RANGE", "p_retailprice", (900.0, 950.0))])
    return X.layered(V.read(spark, sf, "part"), tree).groupBy("layer").agg(F.count("*").alias("n"))


@query("FLT_12_listed", """SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01' AND (o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP '1997-01-01') GROUP BY 1""")
def listed(spark, sf):
    o = V.read(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("delisted"))
    return o.where("start <= DATE '1999-01-01' AND (delisted IS NULL OR delisted >= DATE '1997-01-01')").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("FLT_13_dense_dates", f"""{A}, d AS (SELECT trade_date FROM bars_a GROUP BY 1 HAVING count(DISTINCT symbol) >= 4) SELECT symbol, trade_date, close FROM bars_a WHERE trade_date IN (SELECT trade_date FROM d)""")
def dense_dates(spark, sf):
    bars = V.bars_a(spark, sf)
    dense = bars.groupBy("trade_date").agg(F.countDistinct("symbol").alias("n")).where("n >= 4")
    return bars.join(dense, "trade_date", "left_semi").select("symbol", "trade_date", "close")


@query("FLT_14_signal_dates", f"""{V.ctes('bars_a', 'days_a')}, n AS (SELECT *, lead(trade_date) OVER (ORDER BY trade_date) AS next, count(*) OVER () AS total FROM days_a) SELECT trade_date, (date_trunc('month', next) <> date_trunc('month', trade_date)) AS month_end FROM n WHERE trade_index > 60 AND total - trade_index >= 20""")
def signal_dates(spark, sf):
    days = pit.trading_days(V.bars_a(spark, sf)).withColumn("total", F.max("trade_index").over(Window.partitionBy(F.lit(0))))
    return days.where("trade_index > 60 AND total - trade_index >= 20").select("trade_date", (F.date_trunc("month", "next_date") != F.date_trunc("month", "trade_date")).alias("month_end"))


@query("FLT_15_coarse_screen", f"""{A}, {V.SQL['statuses']}, u AS (SELECT *, close > lag(close) {BY}) AS up FROM bars_a), k AS (SELECT symbol, trade_date, amount, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k FROM u
WHERE up AND NOT EXISTS (SELECT 1 FROM statuses s WHERE s.symbol = u.symbol AND s.status = 'P' AND s.valid_from <= u.trade_date AND (s.valid_to IS NULL OR s.valid_to > u.trade_date))) SELECT symbol, trade_date, amount, k AS place FROM k WHERE k <= 3""")
def coarse_screen(spark, sf):
    bars = V.bars_a(spark, sf).withColumn("up", F.col("close") > F.lag("close").over(T.SYMBOL)).where("up")
    stopped = V.statuses(spark, sf).where("status = 'P'").select("symbol", "valid_from", "valid_to")
    free = pit.interval_join(bars, stopped, "symbol", "trade_date", "valid_from", "valid_to", "left_anti", closed=False)
    by = Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol")
    return free.withColumn("place", F.row_number().over(by)).where("place <= 3").select("symbol", "trade_date", "amount", F.col("place").cast("long").alias("place"))


@query("FLT_17_identity_search", """WITH m AS (SELECT s_suppkey, s_name, CASE WHEN s_name = 'Supplier#000000001' THEN 0 WHEN starts_with(s_name, 'Supplier#00000000') THEN 1 WHEN s_name ILIKE '%plier#%1%' THEN 2 END AS rank FROM supplier) SELECT s_suppkey, s_name, rank FROM m WHERE rank IS NOT NULL ORDER BY rank, s_suppkey LIMIT 20""")
def identity_search(spark, sf):
    rank = F.when(F.col("s_name") == "Supplier#000000001", 0).when(F.col("s_name").startswith("Supplier#00000000"), 1).when(F.col("s_name").ilike("%plier#%1%"), 2)
    return V.read(spark, sf, "supplier").select("s_suppkey", "s_name", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "s_suppkey").limit(20)


# Joins


@query("JOIN_2_star", """SELECT n_name, r_name, p_type, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def star(spark, sf):
    t = {n: V.read(spark, sf, n) for n in ("lineitem", "supplier", "nation", "region", "part")}
    full = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t["part"], F.col("l_partkey") == F.col("p_partkey"), "left")
    return full.groupBy("n_name", "r_name", "p_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("JOIN_3_intervals", f"""{A}, {V.SQL['statuses']} SELECT b.symbol, trade_date, bool_or(status = 'P') AS stopped, count(*) AS n FROM bars_a b JOIN statuses s ON b.symbol = s.symbol AND trade_date >= valid_from AND (valid_to IS NULL OR trade_date <= valid_to) GROUP BY ALL""")
def intervals(spark, sf):
    days = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"))  # the keys of bars_a
    counts = {"n": F.lit(True), "known": F.col("status").isNotNull(), "paused": F.col("status") == "P"}
    told = pit.covering(days, V.statuses(spark, sf), "symbol", "trade_date", "valid_from", "valid_to", counts)
    return told.select("symbol", "trade_date", F.when(F.col("known") > 0, F.col("paused") > 0).alias("stopped"), "n")


@query("JOIN_4_pit_membership", f"""{A}, {V.SQL['statuses']}, j AS (SELECT b.symbol, trade_date, status, status_id, row_number() OVER (PARTITION BY b.symbol, trade_date ORDER BY valid_from DESC NULLS LAST, valid_from + 3 DESC NULLS LAST, status_id DESC NULLS LAST) AS k
FROM bars_a b LEFT JOIN statuses s ON b.symbol = s.symbol AND valid_from <= trade_date AND (valid_to IS NULL OR valid_to >= trade_date) AND valid_from + 3 <= trade_date) SELECT symbol, trade_date, status, status_id FROM j WHERE k = 1""")
def pit_membership(spark, sf):
    m = V.statuses(spark, sf).withColumn("available", F.date_add("valid_from", 3)).withColumnRenamed("status_id", "membership_id")
    rows = V.bars_a(spark, sf).select("symbol", "trade_date")
    return pit.pit_membership(rows, m, ["symbol", "trade_date"], "trade_date", "trade_date").select("symbol", "trade_date", "status", F.col("membership_id").alias("status_id"))


@query("JOIN_5_asof", f"""{A}, {V.SQL['statements']} SELECT b.symbol, b.trade_date, s.period, s.revenue FROM bars_a b ASOF LEFT JOIN (SELECT symbol, period, revenue, available FROM statements QUALIFY row_number() OVER (PARTITION BY symbol, available ORDER BY period DESC) = 1) s ON b.symbol = s.symbol AND b.trade_date >= s.available""")
def asof(spark, sf):
    rows = V.bars_a(spark, sf).select("symbol", "trade_date")
    joined = pit.asof_join(rows, V.statements(spark, sf), ["symbol"], "trade_date", "available", ["period"])
    return joined.select("symbol", "trade_date", F.col("asof.period").alias("period"), F.col("asof.revenue").alias("revenue"))


@query("JOIN_6_calendar_offset", f"""{V.ctes('bars_b', 'days_b')}, i AS (SELECT symbol, trade_date, trade_index, close FROM bars_b JOIN days_b USING (trade_date)) SELECT a.symbol, a.trade_date, e.close AS entry, x.close AS "exit" FROM i a LEFT JOIN i e ON a.symbol = e.symbol AND e.trade_index = a.trade_index + 1 LEFT JOIN i x ON a.symbol = x.symbol AND x.trade_index = a.trade_index + 5""")
def calendar_offset(spark, sf):
    i = pit.with_trade_index(V.bars_b(spark, sf)).select("symbol", "trade_date", "trade_index", "close")
    at = lambda k, n: i.select("symbol", (F.col("trade_index") - k).alias("trade_index"), F.col("close").alias(n))
    return i.join(at(1, "entry"), ["symbol", "trade_index"], "left").join(at(5, "exit"), ["symbol", "trade_index"], "left").select("symbol", "trade_date", "entry", "exit")


@query("JOIN_7_dense_grid", f"""{V.ctes('bars_b', 'days_b')} SELECT s.symbol, d.trade_date, d.trade_index, b.close FROM (SELECT DISTINCT symbol FROM bars_b) s CROSS JOIN days_b d LEFT JOIN bars_b b ON b.symbol = s.symbol AND b.trade_date = d.trade_date""")
def dense_grid(spark, sf):
    bars = V.bars_b(spark, sf)
    grid = pit.dense_grid(bars.select("symbol").distinct(), pit.trading_days(bars).select("trade_date", "trade_index"), bars)
    return grid.select("symbol", "trade_date", F.col("trade_index").cast("long").alias("trade_index"), "close")


@query("JOIN_8_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi(spark, sf):
    keys = V.read(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return V.read(spark, sf, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("JOIN_9_anti", f"""{A}, {V.SQL['statuses']} SELECT symbol, trade_date FROM bars_a b WHERE NOT EXISTS (SELECT 1 FROM statuses s WHERE s.symbol = b.symbol AND status = 'O' AND valid_from <= trade_date AND (valid_to IS NULL OR trade_date <= valid_to))""")
def anti(spark, sf):
    open_ = V.statuses(spark, sf).where("status = 'O'").select("symbol", "valid_from", "valid_to")
    return pit.interval_join(V.bars_a(spark, sf).select("symbol", "trade_date"), open_, "symbol", "trade_date", "valid_from", "valid_to", "left_anti")


TOP = f"top AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k FROM bars_b)"


@query("JOIN_10_retention", f"""{V.ctes('bars_b', 'days_b')}, {TOP}, t AS (SELECT symbol, trade_index FROM top JOIN days_b USING (trade_date) WHERE k <= 20) SELECT a.trade_index, count(*) AS n, count(b.symbol) AS retained, round(1 - count(b.symbol)::DOUBLE / count(*), 6) AS turnover FROM t a LEFT JOIN t b ON a.symbol = b.symbol AND b.trade_index = a.trade_index - 1 GROUP BY 1""")
def retention_join(spark, sf):
    by = Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol")
    t = pit.with_trade_index(V.bars_b(spark, sf).withColumn("k", F.row_number().over(by)).where("k <= 20")).select("symbol", F.col("trade_index").cast("long").alias("trade_index"))
    before = t.select("symbol", (F.col("trade_index") + 1).alias("trade_index"), F.lit(1).alias("was"))
    return t.join(before, ["symbol", "trade_index"], "left").groupBy("trade_index").agg(F.count("*").alias("n"), F.count("was").alias("retained"), F.round(1 - F.count("was") / F.count("*"), 6).alias("turnover"))


@query("JOIN_12_scalar", f"""{A} SELECT symbol, close FROM bars_a WHERE trade_date = (SELECT max(trade_date) FROM bars_a WHERE trade_date <= DATE '2000-06-30')""")
def scalar(spark, sf):
    bars = V.bars_a(spark, sf)
    last = bars.where("trade_date <= '2000-06-30'").agg(F.max("trade_date").alias("trade_date"))
    return bars.join(F.broadcast(last), "trade_date").select("symbol", "close")  # one row


@query("JOIN_14_barrier", f"""{V.ctes('bars_b', 'days_b')}, i AS (SELECT symbol, trade_date, trade_index, close FROM bars_b JOIN days_b USING (trade_date)), h AS (SELECT a.symbol, a.trade_date, b.trade_index, CASE WHEN b.close <= a.close * 0.5 THEN 'STOP' WHEN b.close >= a.close * 2 THEN 'TARGET' WHEN b.trade_index = a.trade_index + 5 THEN 'EXPIRY' END AS reason, CASE WHEN b.close <= a.close * 0.5 THEN 0 ELSE 1 END AS p
FROM i a JOIN i b ON a.symbol = b.symbol AND b.trade_index BETWEEN a.trade_index + 1 AND a.trade_index + 5) SELECT symbol, trade_date, arg_min(reason, trade_index * 10 + p) AS reason, min(trade_index) AS at_index FROM h WHERE reason IS NOT NULL GROUP BY 1, 2""")
def barrier(spark, sf):
    i = pit.with_trade_index(V.bars_b(spark, sf)).select("symbol", "trade_date", F.col("trade_index").cast("long").alias("trade_index"), "close")
    # each row meets its next five sessions by key: no range join
    ahead = i.select("symbol", "trade_date", F.col("close").alias("base"), F.col("trade_index").alias("start"), F.explode(F.sequence(F.col("trade_index") + 1, F.col("trade_index") + 5)).alias("trade_index"))
    met = ahead.join(i.select("symbol", "trade_index", "close"), ["symbol", "trade_index"])
    reason = F.when(F.col("close") <= F.col("base") * 0.5, "STOP").when(F.col("close") >= F.col("base") * 2, "TARGET").when(F.col("trade_index") == F.col("start") + 5, "EXPIRY")
    hit = met.withColumn("reason", reason).where("reason IS NOT NULL")
    return hit.groupBy("symbol", "trade_date").agg(F.min_by("reason", F.struct("trade_index", (F.col("reason") != "STOP").cast("int"))).alias("reason"), F.min("trade_index").alias("at_index"))


@query("JOIN_15_next_executable", f"""{V.ctes('bars_b', 'days_b')}, g AS (SELECT s.symbol, d.trade_date, d.trade_index, b.close FROM (SELECT DISTINCT symbol FROM bars_b) s CROSS JOIN days_b d LEFT JOIN bars_b b ON b.symbol = s.symbol AND b.trade_date = d.trade_date)
SELECT symbol, trade_date, min(CASE WHEN close IS NOT NULL THEN trade_index END) OVER (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS exit_index FROM g""")
def next_executable(spark, sf):
    bars = V.bars_b(spark, sf)
    grid = pit.dense_grid(bars.select("symbol").distinct(), pit.trading_days(bars).select("trade_date", "trade_index"), bars)
    w = Window.partitionBy("symbol").orderBy("trade_index").rowsBetween(3, Window.unboundedFollowing)
    return grid.select("symbol", "trade_date", F.min(F.when(F.col("close").isNotNull(), F.col("trade_index"))).over(w).cast("long").alias("exit_index"))


@query("JOIN_16_paired", f"""{B}, d AS (SELECT trade_date, avg(close) FILTER (WHERE symbol % 2 = 0) AS a, avg(close) FILTER (WHERE symbol % 2 = 1) AS b FROM bars_b GROUP BY 1) SELECT trade_date, round(a - b, 6) AS delta FROM d WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired(spark, sf):
    side = lambda k, n: V.bars_b(spark, sf).where(F.col("symbol") % 2 == k).groupBy("trade_date").agg(F.avg("close").alias(n))
    return side(0, "a").join(side(1, "b"), "trade_date").select("trade_date", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("JOIN_17_reconcile", f"""{A}, s AS (SELECT symbol, trade_date, close * CASE WHEN symbol % 7 = 0 THEN 1.02 ELSE 1 END AS close, volume FROM bars_a WHERE symbol % 5 <> 0), j AS (SELECT b.symbol, unnest([{{'f': 'close', 'a': b.close, 'b': s.close}}, {{'f': 'volume', 'a': b.volume, 'b': s.volume}}]) AS x FROM bars_a b LEFT JOIN s USING (symbol, trade_date))
SELECT x.f AS field, count(*) AS n, count(x.b) AS compared, count(*) FILTER (WHERE abs(x.a - x.b) <= greatest(1e-6, 0.001 * greatest(abs(x.a), abs(x.b)))) AS matched FROM j GROUP BY 1""")
def reconcile(spark, sf):
    bars = V.bars_a(spark, sf).select("symbol", "trade_date", "close", "volume")
    shadow = bars.where("symbol % 5 <> 0").withColumn("close", F.col("close") * F.when(F.col("symbol") % 7 == 0, 1.02).otherwise(1.0))
    rows = landing.reconciled(bars, shadow, ["symbol", "trade_date"], {"close": (1e-6, 0.001), "volume": (1e-6, 0.001)})
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count("b").alias("compared"), F.count_if(F.col("b").isNotNull() & F.col("matched")).alias("matched"))


# Sorts and sets


@query("SRT_3_top_per_group", f"""{B}, {TOP} SELECT symbol, trade_date, k FROM top WHERE k <= 3""")
def top_per_group(spark, sf):
    by = Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol")
    return V.bars_b(spark, sf).withColumn("k", F.row_number().over(by)).where("k <= 3").select("symbol", "trade_date", F.col("k").cast("long").alias("k"))


@query("SRT_4_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paging(spark, sf):
    return V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("SRT_5_top_fraction", f"""{B}, k AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM bars_b) SELECT symbol, trade_date FROM k WHERE k <= greatest(1, ceil(n * 0.1))""")
def top_fraction(spark, sf):
    by = Window.partitionBy("trade_date")
    k = V.bars_b(spark, sf).withColumns({"k": F.row_number().over(by.orderBy(F.desc("amount"), "symbol")), "n": F.count("*").over(by)})
    return k.where(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).select("symbol", "trade_date")


@query("SRT_6_top_bottom", f"""{B}, k AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS t, row_number() OVER (PARTITION BY trade_date ORDER BY close, symbol) AS b, count(DISTINCT close) OVER (PARTITION BY trade_date) AS d FROM bars_b) SELECT symbol, trade_date, 'TOP' AS side FROM k WHERE t <= 10 AND d >= 2 UNION ALL SELECT symbol, trade_date, 'BOTTOM' FROM k WHERE b <= 10 AND d >= 2""")
def top_bottom(spark, sf):
    by = Window.partitionBy("trade_date")
    k = V.bars_b(spark, sf).withColumns({"t": F.row_number().over(by.orderBy(F.desc("close"), "symbol")), "b": F.row_number().over(by.orderBy("close", "symbol")), "d": F.size(F.collect_set("close").over(by))}).where("d >= 2")
    return k.select("symbol", "trade_date", F.explode(C.flags(TOP=F.col("t") <= 10, BOTTOM=F.col("b") <= 10)).alias("side"))


@query("SRT_8_rank_groups", f"""{B}, p AS (SELECT symbol, trade_date, percent_rank() OVER (PARTITION BY trade_date ORDER BY amount DESC) AS pr FROM bars_b), g AS (SELECT trade_date, unnest(list_filter([CASE WHEN pr < 0.1 THEN 'TOP_10' END, CASE WHEN pr < 0.2 THEN 'TOP_20' END, CASE WHEN pr >= 0.2 AND pr <= 0.8 THEN 'MIDDLE' END, CASE WHEN pr > 0.8 THEN 'BOTTOM_20' END, CASE WHEN pr > 0.9 THEN 'BOTTOM_10' END], lambda x: x IS NOT NULL)) AS grp FROM p) SELECT trade_date, grp, count(*) AS n FROM g GROUP BY ALL""")
def rank_groups(spark, sf):
    p = V.bars_b(spark, sf).withColumn("pr", F.percent_rank().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"))))
    pr = F.col("pr")
    groups = C.flags(TOP_10=pr < 0.1, TOP_20=pr < 0.2, MIDDLE=(pr >= 0.2) & (pr <= 0.8), BOTTOM_20=pr > 0.8, BOTTOM_10=pr > 0.9)
    return p.select("trade_date", F.explode(groups).alias("grp")).groupBy("trade_date", "grp").agg(F.count("*").alias("n"))


@query("SET_2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return V.read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(V.read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SET_4_overlap", """WITH s AS (SELECT o_custkey % 50 AS k, list_sort(list(DISTINCT o_orderkey % 200)) AS v FROM orders GROUP BY 1) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.v, b.v))::DOUBLE / nullif(len(list_distinct(list_concat(a.v, b.v))), 0), 6) AS jaccard, round(len(list_intersect(a.v, b.v))::DOUBLE / nullif(least(len(a.v), len(b.v)), 0), 6) AS overlap FROM s a JOIN s b ON b.k = a.k + 1""")
def overlap(spark, sf):
    s = V.read(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.collect_set(F.col("o_orderkey") % 200).alias("v"))
    j = s.select(F.col("k").alias("a"), F.col("v").alias("va")).join(s.select(F.col("k").alias("b"), F.col("v").alias("vb")), F.col("b") == F.col("a") + 1)
    small = C.ratio(F.size(F.array_intersect("va", "vb")).cast("double"), F.least(F.size("va"), F.size("vb")))
    return j.select("a", "b", F.round(C.jaccard("va", "vb"), 6).alias("jaccard"), F.round(small, 6).alias("overlap"))


@query("SET_5_retained_winners", f"""{B}, {RETS}, w AS (SELECT symbol, trade_date, ret, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS c FROM rets) SELECT trade_date, count(*) FILTER (WHERE k <= 30 AND ret > 0) AS winners, count(*) FILTER (WHERE k <= 30 AND ret > 0 AND c <= 60) AS retained, count(*) FILTER (WHERE k <= 30 AND ret <= 0 AND c > 60) AS avoided FROM w GROUP BY 1""")
def retained_winners(spark, sf):
    by = Window.partitionBy("trade_date")
    w = rets(spark, sf).withColumns({"k": F.row_number().over(by.orderBy(F.desc("amount"), "symbol")), "c": F.row_number().over(by.orderBy(F.desc("close"), "symbol"))})
    return w.groupBy("trade_date").agg(F.count_if(F.expr("k <= 30 AND ret > 0")).alias("winners"), F.count_if(F.expr("k <= 30 AND ret > 0 AND c <= 60")).alias("retained"), F.count_if(F.expr("k <= 30 AND ret <= 0 AND c > 60")).alias("avoided"))
