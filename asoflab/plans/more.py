"""Further queries: sources and sinks, boards, trends, audits, selection and outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import evaluate as E
from asoflab.operators import market as M
from asoflab.operators import pit
from asoflab.operators import timeseries as T
from asoflab.plans.features import A, B, BY, PATH, RETS, r, rets
from asoflab.plans.registry import query
from asoflab.plans.research import EVAL, scored
from asoflab.sources import views as V


@query("SRC_2_several_stores", """SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""")
def several_stores(spark, sf):
    t = {n: V.read(spark, sf, n) for n in ("customer", "nation", "orders")}
    live = t["orders"].where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t["customer"].join(live, "c_custkey", "left_semi").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("FLT_10_scope", """SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (n_name LIKE '%1%' OR n_name LIKE '%3%') AND n_regionkey <> 2 AND s_suppkey NOT IN (1, 2, 3)""")
def scope(spark, sf):
    j = V.read(spark, sf, "supplier").join(V.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.where((F.col("n_name").contains("1") | F.col("n_name").contains("3")) & (F.col("n_regionkey") != 2) & ~F.col("s_suppkey").isin(1, 2, 3)).select("s_suppkey")


@query("FLT_11_staleness", f"""{A} SELECT symbol, max(trade_date) AS last, (SELECT max(trade_date) FROM bars_a) - max(trade_date) > 5 AS stale FROM bars_a GROUP BY 1""")
def staleness(spark, sf):
    bars = V.bars_a(spark, sf)
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("last"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("m")))).select("symbol", "last", (F.datediff("m", "last") > 5).alias("stale"))  # one row


@query("FLT_16_daily_layer", f"""{A}, s AS (SELECT close, avg(close) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, avg(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60, count(*) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM bars_a) SELECT CASE WHEN n < 60 THEN 'UNKNOWN' WHEN close > m20 AND m20 > m60 THEN 'CORE' WHEN close > m20 THEN 'NEAR' ELSE 'CONTROL' END AS layer, count(*) AS n FROM s GROUP BY 1""")
def daily_layer(spark, sf):
    s = V.bars_a(spark, sf).select("close", C.sma("close", T.SYMBOL, 20).alias("m20"), C.sma("close", T.SYMBOL, 60).alias("m60"))
    layer = F.when(F.col("m60").isNull(), "UNKNOWN").when((F.col("close") > F.col("m20")) & (F.col("m20") > F.col("m60")), "CORE").when(F.col("close") > F.col("m20"), "NEAR").otherwise("CONTROL")
    return s.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("FLT_18_SRT_7_boards", f"""{B}, {RETS}, t AS (SELECT symbol, ret, amount, volume FROM rets WHERE trade_date = DATE '2024-01-20' AND close > 0 AND ret BETWEEN 0.02 AND 9.5 AND volume >= 1) SELECT symbol, round(ret, 6) AS ret, amount FROM t ORDER BY round(ret, 6) DESC, amount DESC, symbol LIMIT 50""")
def boards(spark, sf):
    t = rets(spark, sf).where("trade_date = DATE '2024-01-20' AND close > 0 AND ret BETWEEN 0.02 AND 9.5 AND volume >= 1")
    return t.select("symbol", F.round("ret", 6).alias("ret"), "amount").orderBy(F.desc("ret"), F.desc("amount"), "symbol").limit(50)


@query("FLT_19_finality", """WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'PRELIMINARY' ELSE 'CORRECTED' END AS finality FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30') SELECT o_custkey, o_orderkey, finality FROM x WHERE finality <> 'PRELIMINARY' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def finality(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "FINAL").when(F.col("o_orderstatus") == "O", "PRELIMINARY").otherwise("CORRECTED")
    x = V.read(spark, sf, "orders").where("o_orderdate <= TIMESTAMP_NTZ '1999-06-30'").withColumn("finality", kind).where("finality <> 'PRELIMINARY'")
    return pit.latest_revision(x, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "finality")


REGISTRY = {"ret": "ret", "gap": "open_gap", "intraday": "intraday", "volume_change": "volume_change"}


@query("PRJ_6_packets", f"""{A}, {PATH}, f AS (SELECT symbol, trade_date, round((close - pc) / nullif(pc, 0), 6) AS ret, round((open - pc) / nullif(pc, 0), 6) AS gap, round((close - open) / nullif(open, 0), 6) AS intraday, round((volume - pv) / nullif(pv, 0), 6) AS volume_change FROM path)
SELECT *, (ret IS NULL)::INT + (gap IS NULL)::INT + (intraday IS NULL)::INT + (volume_change IS NULL)::INT AS missing, CASE WHEN ret IS NULL AND gap IS NULL THEN 'MISSING' ELSE 'VALID' END AS status, array_to_string(list_filter([CASE WHEN ret IS NULL THEN 'NO_ret' END, CASE WHEN gap IS NULL THEN 'NO_gap' END, CASE WHEN intraday IS NULL THEN 'NO_intraday' END, CASE WHEN volume_change IS NULL THEN 'NO_volume_change' END], lambda x: x IS NOT NULL), ',') AS flags FROM f""")
def packets(spark, sf):
    f = r(T.path_features(V.bars_a(spark, sf)), ["symbol", "trade_date"], **{n: F.col(c) for n, c in REGISTRY.items()})
    missing = sum((F.col(n).isNull().cast("int") for n in REGISTRY), F.lit(0))
    status = F.when(F.col("ret").isNull() & F.col("gap").isNull(), "MISSING").otherwise("VALID")
    return f.withColumns({"missing": missing, "status": status, "flags": F.array_join(C.flags(**{f"NO_{n}": F.col(n).isNull() for n in REGISTRY}), ",")})


@query("JOIN_18_reactions", f"""{B}, {RETS}, e AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2), j AS (SELECT e.symbol, e.d, x.ret FROM e ASOF LEFT JOIN (SELECT symbol, trade_date, ret FROM rets) x ON e.symbol = x.symbol AND e.d < x.trade_date)
SELECT CASE WHEN ret IS NULL THEN 'INSUFFICIENT' WHEN ret < -0.2 THEN 'CONFIRMED' WHEN ret > 0.2 THEN 'REJECTED' ELSE 'ABSORBED' END AS reaction, count(*) AS n FROM j GROUP BY 1""")
def reactions(spark, sf):
    e = V.read(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("d")).distinct()
    # the next session after an event: an as-of join on mirrored dates
    mirror = lambda c: -F.unix_date(F.col(c))
    x = rets(spark, sf).select("symbol", mirror("trade_date").alias("m"), "ret")
    j = pit.asof_join(e.withColumn("k", mirror("d") - 1), x, ["symbol"], "k", "m")
    ret = F.col("asof.ret")
    kind = F.when(ret.isNull(), "INSUFFICIENT").when(ret < -0.2, "CONFIRMED").when(ret > 0.2, "REJECTED").otherwise("ABSORBED")
    return j.groupBy(kind.alias("reaction")).agg(F.count("*").alias("n"))


@query("JOIN_19_deviations", """WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SELL' ELSE 'BUY' END AS side, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 <> 0), t AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT array_to_string(list_filter([CASE WHEN d.o_orderkey IS NULL THEN 'NO_DECISION' END, CASE WHEN d.side <> t.side THEN 'OPPOSITE_SIDE' END, CASE WHEN t.d < d.d THEN 'TOO_EARLY' END], lambda x: x IS NOT NULL), ',') AS deviations, count(*) AS n FROM t LEFT JOIN d ON o_orderkey = l_orderkey GROUP BY 1""")
def deviations(spark, sf):
    d = V.read(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("ds"), F.to_date("o_orderdate").alias("dd"))
    t = V.read(spark, sf, "lineitem").select(F.col("l_orderkey"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("ts"), F.to_date("l_shipdate").alias("td"))
    j = t.join(d, F.col("l_orderkey") == F.col("k"), "left")
    f = C.flags(NO_DECISION=F.col("k").isNull(), OPPOSITE_SIDE=F.col("ds") != F.col("ts"), TOO_EARLY=F.col("td") < F.col("dd"))
    return j.groupBy(F.array_join(f, ",").alias("deviations")).agg(F.count("*").alias("n"))


@query("AGG_19_platform_coverage", """SELECT (SELECT count(*) FROM supplier) AS universe, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS with_bars, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE length(text) >= 200) AS full_text, (SELECT min(ts)::DATE FROM events) AS first_day, (SELECT max(ts)::DATE FROM events) AS last_day""")
def platform_coverage(spark, sf):
    t = lambda n: V.read(spark, sf, n)
    parts = [t("supplier").agg(F.count("*").alias("universe")), t("lineitem").agg(F.countDistinct("l_suppkey").alias("with_bars")), t("documents").agg(F.count("*").alias("documents"), F.count_if(F.length("text") >= 200).alias("full_text")), t("events").agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("AGG_27_seats", """WITH s AS (SELECT l_suppkey AS symbol, l_partkey % 7 AS seat, sum(CASE l_returnflag WHEN 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS net FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2) SELECT u.s_suppkey AS symbol, count(seat) AS seats, round(sum(CASE WHEN seat < 2 THEN net END), 2) AS institution_net FROM supplier u LEFT JOIN s ON s.symbol = u.s_suppkey GROUP BY 1""")
def seats(spark, sf):
    s = V.read(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 7).alias("seat")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))).alias("net"))
    j = V.read(spark, sf, "supplier").select("s_suppkey").join(s, "s_suppkey", "left")
    return j.groupBy(F.col("s_suppkey").alias("symbol")).agg(F.count("seat").alias("seats"), F.round(F.sum(F.when(F.col("seat") < 2, F.col("net"))), 2).alias("institution_net"))


@query("AGG_33_quality_ratios", f"""{A}, {PATH} SELECT count(*) AS n, round(avg((pc IS NULL)::INT::DOUBLE), 6) AS missing, round(avg((high = low)::INT::DOUBLE), 6) AS flat, round(avg((volume > 50)::INT::DOUBLE), 6) AS heavy FROM path""")
def quality_ratios(spark, sf):
    x = T.path_features(V.bars_a(spark, sf))
    share = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    return x.agg(F.count("*").alias("n"), share(F.col("previous_close").isNull(), "missing"), share(F.col("high") == F.col("low"), "flat"), share(F.col("volume") > 50, "heavy"))


@query("AGG_36_signal_metrics", f"""{B}, {RETS}, f AS (SELECT trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS rank, lead(ret) {BY}) AS fwd FROM rets), s AS (SELECT CASE WHEN rank <= 10 THEN 'TOP' WHEN rank <= 30 THEN 'NEXT' ELSE 'REST' END AS kind, rank, fwd FROM f WHERE fwd IS NOT NULL) SELECT kind, count(*) AS n, round(avg(fwd), 5) AS mean, round(median(fwd), 5) AS med, round(stddev_samp(fwd), 4) AS sd, round(covar_pop(rank, fwd) / nullif(stddev_pop(rank) * stddev_pop(fwd), 0), 5) AS rank_corr FROM s GROUP BY 1""")
def signal_metrics(spark, sf):
    f = rets(spark, sf).withColumns({"rank": F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol")), "fwd": F.lead("ret").over(T.SYMBOL)}).where("fwd IS NOT NULL")
    kind = F.when(F.col("rank") <= 10, "TOP").when(F.col("rank") <= 30, "NEXT").otherwise("REST")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("fwd"), 5).alias("mean"), F.round(F.percentile("fwd", F.lit(0.5)), 5).alias("med"), F.round(F.stddev_samp("fwd"), 4).alias("sd"), F.round(C.pearson(F.col("rank").cast("double"), "fwd"), 5).alias("rank_corr"))


@query("AGG_37_delays", """WITH d AS (SELECT o_orderpriority AS grp, least(5, (CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) // 30) AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate) SELECT grp, count(*) AS n, round(avg((delay = 0)::INT::DOUBLE), 6) AS d0, round(avg((delay = 1)::INT::DOUBLE), 6) AS d1, round(avg((delay = 5)::INT::DOUBLE), 6) AS d5 FROM d GROUP BY 1""")
def delays(spark, sf):
    j = V.read(spark, sf, "lineitem").join(V.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    d = j.select(F.col("o_orderpriority").alias("grp"), F.least(F.lit(5), F.floor(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) / 30)).alias("delay"))
    share = lambda k: F.round(F.avg((F.col("delay") == k).cast("double")), 6).alias(f"d{k}")
    return d.groupBy("grp").agg(F.count("*").alias("n"), share(0), share(1), share(5))


@query("AGG_41_event_sentiment", """WITH l AS (SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, round(least(1, greatest(-1, sum((value - 50) / 100 * 0.5) / sqrt(count(*)))), 6) AS score, round(CASE WHEN avg((event_type = 'error')::INT::DOUBLE) >= 0.5 THEN 0.5 ELSE 1 END * 0.8, 4)::DOUBLE AS confidence, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS evidence FROM l GROUP BY 1""")
def event_sentiment(spark, sf):
    l = pit.latest_revision(V.read(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    score = C.clip(F.sum((F.col("value") - 50) / 100 * 0.5) / F.sqrt(F.count("*").cast("double")))
    rumours = F.avg((F.col("event_type") == "error").cast("double"))
    return l.groupBy("user_id").agg(F.round(score, 6).alias("score"), F.round(F.when(rumours >= 0.5, 0.5).otherwise(1.0) * 0.8, 4).alias("confidence"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("evidence"))


@query("AGG_44_source_counts", "SELECT source, lang, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY ALL")
def source_counts(spark, sf):
    return V.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("AGG_46_quality_gate", f"""{A}, x AS (SELECT unnest([{{'f': 'close', 'ok': close = round(close, 4)}}, {{'f': 'volume', 'ok': volume = round(volume)}}]) AS e FROM bars_a) SELECT e.f AS field, round(avg(e.ok::INT::DOUBLE), 6) AS matched, avg(e.ok::INT::DOUBLE) >= 0.99 AS passed FROM x GROUP BY 1""")
def quality_gate(spark, sf):
    e = F.array(F.struct(F.lit("close").alias("field"), (F.col("close") == F.round("close", 4)).alias("ok")), F.struct(F.lit("volume").alias("field"), (F.col("volume") == F.round("volume")).alias("ok")))
    x = V.bars_a(spark, sf).select(F.explode(e).alias("e")).select("e.*")
    share = F.avg(F.col("ok").cast("double"))
    return x.groupBy("field").agg(F.round(share, 6).alias("matched"), (share >= 0.99).alias("passed"))


@query("AGG_49_layers", f"""{B}, {RETS}, d AS (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31') AS now, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS before FROM events GROUP BY 1) SELECT user_id, now, before, round((now - before) / nullif(before, 0), 6) AS growth FROM d""")
def layers(spark, sf):
    week = lambda a, b: F.count_if(F.expr(f"ts >= TIMESTAMP_NTZ '{a}' AND ts < TIMESTAMP_NTZ '{b}'"))
    d = V.read(spark, sf, "events").groupBy("user_id").agg(week("2024-01-24", "2024-01-31").alias("now"), week("2024-01-17", "2024-01-24").alias("before"))
    return d.select("user_id", "now", "before", F.round(C.change("now", "before"), 6).alias("growth"))


@query("AGG_43_environment", f"""{B}, {RETS}, d AS (SELECT trade_date, avg(ret) AS m, avg((ret > 0)::INT::DOUBLE) AS up, sum(amount) AS a FROM rets GROUP BY 1) SELECT trade_date, m > 0 AS rising, up > 0.5 AS broad, CASE WHEN count(*) OVER w = 5 THEN a > avg(a) OVER w END AS active FROM d WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def environment(spark, sf):
    d = rets(spark, sf).groupBy("trade_date").agg(F.avg("ret").alias("m"), F.avg((F.col("ret") > 0).cast("double")).alias("up"), F.sum("amount").alias("a"))
    w = M.days().rowsBetween(-5, -1)
    return d.select("trade_date", (F.col("m") > 0).alias("rising"), (F.col("up") > 0.5).alias("broad"), F.when(F.count("*").over(w) == 5, F.col("a") > F.avg("a").over(w)).alias("active"))


@query("WIN_21_random_top")
def random_top(spark, sf):
    by = Window.partitionBy("trade_date").orderBy(F.xxhash64("symbol", F.lit(42)), "symbol")
    return V.bars_b(spark, sf).withColumn("k", F.row_number().over(by)).where("k <= 5").select("trade_date", "symbol", "k")


@query("TS_17_capital_score", f"""{A}, s AS (SELECT symbol, trade_date, amount / nullif(avg(amount) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS a, volume / nullif(avg(volume) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS v, count(*) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM bars_a) SELECT symbol, trade_date, CASE WHEN n = 5 THEN round(0.5 * least(1, greatest(-1, log2(a) / 2)) + 0.5 * least(1, greatest(-1, log2(v) / 2)), 5) END AS score FROM s""")
def capital_score(spark, sf):
    s = V.bars_a(spark, sf).withColumns({"a": T.ratio_to_prior_mean("amount", T.SYMBOL, 5), "v": T.ratio_to_prior_mean("volume", T.SYMBOL, 5)})
    return r(s, ["symbol", "trade_date"], 5, score=C.weighted_mean((C.clip(F.log2("a") / 2), 0.5), (C.clip(F.log2("v") / 2), 0.5)))


@query("TS_19_trend_states", f"""{A}, d AS (SELECT symbol, trade_date, amount - lag(amount) {BY}) AS d FROM bars_a), w AS (SELECT symbol, trade_date, min(d) OVER w AS lo, max(d) OVER w AS hi, count(d) OVER w AS n FROM d WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT CASE WHEN n < 5 THEN 'MISSING' WHEN lo > 0 THEN 'RISING' WHEN hi < 0 THEN 'FALLING' WHEN hi - lo > 100000 THEN 'VOLATILE' ELSE 'STABLE' END AS state, count(*) AS n FROM w GROUP BY 1""")
def trend_states(spark, sf):
    w = C.trailing(T.SYMBOL, 5)
    d = V.bars_a(spark, sf).withColumn("d", F.col("amount") - F.lag("amount").over(T.SYMBOL)).select(F.min("d").over(w).alias("lo"), F.max("d").over(w).alias("hi"), F.count("d").over(w).alias("k"))
    state = F.when(F.col("k") < 5, "MISSING").when(F.col("lo") > 0, "RISING").when(F.col("hi") < 0, "FALLING").when(F.col("hi") - F.col("lo") > 100000, "VOLATILE").otherwise("STABLE")
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("TS_21_DOM_50_calibrated", f"""{B}, {RETS}, q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3 FROM rets WHERE trade_date < DATE '2024-01-16') SELECT CASE WHEN amount <= q1 THEN 1 WHEN amount <= q2 THEN 2 WHEN amount <= q3 THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(ret), 5) AS ret, round(avg(CASE WHEN amount >= q3 THEN 0.1 * least(2, 1 + (amount - q3) / nullif(q3 - q2, 0)) ELSE 0 END), 6) AS penalty FROM rets CROSS JOIN q WHERE trade_date >= DATE '2024-01-16' GROUP BY 1""")
def calibrated(spark, sf):
    x = rets(spark, sf)
    edges = x.where("trade_date < DATE '2024-01-16'").agg(F.percentile("amount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    v = x.where("trade_date >= DATE '2024-01-16'").crossJoin(F.broadcast(edges))  # one row
    q = lambda k: F.col("q")[k]
    quartile = F.when(F.col("amount") <= q(0), 1).when(F.col("amount") <= q(1), 2).when(F.col("amount") <= q(2), 3).otherwise(4)
    penalty = F.when(F.col("amount") >= q(2), F.least(F.lit(2.0), 1 + C.ratio(F.col("amount") - q(2), q(2) - q(1))) * 0.1).otherwise(0.0)
    return v.withColumn("quartile", quartile).withColumn("pen", penalty).groupBy("quartile").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 5).alias("ret"), F.round(F.avg("pen"), 6).alias("penalty"))


@query("TS_25_controls", f"""{A}, {PATH}, g AS (SELECT symbol, trade_date, close, amount, ln(close / pc) AS g FROM path) SELECT symbol, trade_date, round(close / nullif(lag(close, 20) {BY}), 0) - 1, 6) AS momentum, CASE WHEN count(g) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN round(stddev_samp(g) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 5) END AS vol, round(ln(1 + avg(amount) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), 5) AS liquidity FROM g""")
def controls(spark, sf):
    w = C.trailing(T.SYMBOL, 20)
    x = V.bars_a(spark, sf).withColumn("g", F.ln(C.ratio("close", F.lag("close").over(T.SYMBOL))))
    return x.select("symbol", "trade_date", F.round(C.ratio("close", F.lag("close", 20).over(T.SYMBOL)) - 1, 6).alias("momentum"), F.round(C.full(F.stddev_samp("g").over(w), F.col("g"), w, 20), 5).alias("vol"), F.round(F.log1p(F.avg("amount").over(w)), 5).alias("liquidity"))


@query("SRT_9_pools", f"""{B}, {RETS}, p AS (SELECT trade_date, symbol, ret, amount FROM rets WHERE abs(ret) > 3) SELECT trade_date, symbol, CASE WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END AS pool, amount FROM p ORDER BY amount DESC, symbol, trade_date LIMIT 100""")
def pools(spark, sf):
    p = rets(spark, sf).where("abs(ret) > 3").select("trade_date", "symbol", F.when(F.col("ret") > 0, "UP").otherwise("DOWN").alias("pool"), "amount")
    return p.orderBy(F.desc("amount"), "symbol", "trade_date").limit(100)


@query("DOM_1_feature_source", f"""{V.ctes('bars_a', 'industries')}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars_a WHERE trade_date <= DATE '2000-06-30'), h AS (SELECT symbol, max(trade_date) AS last, count(*) AS bars, round(avg(close), 6) AS mean FROM k WHERE k <= 61 GROUP BY 1) SELECT h.*, industry, round(s_acctbal, 2) AS balance FROM h LEFT JOIN industries USING (symbol) LEFT JOIN supplier ON s_suppkey = symbol""")
def feature_source(spark, sf):
    bars = V.bars_a(spark, sf).where("trade_date <= DATE '2000-06-30'")
    h = pit.last_rows(bars, ["symbol"], [F.desc("trade_date")], 61).groupBy("symbol").agg(F.max("trade_date").alias("last"), F.count("*").alias("bars"), F.round(F.avg("close"), 6).alias("mean"))
    balance = V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.round("s_acctbal", 2).alias("balance"))
    return h.join(V.industries(spark, sf).select("symbol", "industry"), "symbol", "left").join(balance, "symbol", "left")


@query("DOM_15_tail_robustness", f"""{EVAL}, t AS (SELECT feature, trade_date, score, fwd, cume_dist() OVER (PARTITION BY feature, trade_date ORDER BY fwd DESC) AS cd FROM pairs), r2 AS (SELECT *, rank() OVER (PARTITION BY feature, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY feature, trade_date, score) - 1) / 2.0::DOUBLE AS rs2, rank() OVER (PARTITION BY feature, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, trade_date, fwd) - 1) / 2.0::DOUBLE AS rr2 FROM t WHERE cd > 0.05),
i2 AS (SELECT feature, trade_date, covar_pop(rs2, rr2) / nullif(stddev_pop(rs2) * stddev_pop(rr2), 0) AS ic2, covar_pop(score, fwd) / nullif(stddev_pop(score) * stddev_pop(fwd), 0) AS p2 FROM r2 GROUP BY 1, 2 HAVING count(*) >= 5) SELECT feature, count(*) AS days, round(avg(ic2), 5) AS rank_ic FROM i2 WHERE p2 IS NOT NULL GROUP BY 1""")
def tail_robustness(spark, sf):
    pairs = scored(spark, sf).where("score IS NOT NULL AND fwd IS NOT NULL")
    cd = F.cume_dist().over(Window.partitionBy("feature", "trade_date").orderBy(F.desc("fwd")))
    d = E.daily_ic(pairs.withColumn("cd", cd).where("cd > 0.05"), ret="fwd", least=5)
    return d.groupBy("feature").agg(F.count("*").alias("days"), F.round(F.avg("rank_ic"), 5).alias("rank_ic"))


@query("DOM_19_classification", f"{EVAL}, s AS (SELECT feature, count(rank_ic) AS days, avg(rank_ic) AS m, stddev_samp(rank_ic) AS sd FROM ic WHERE ic IS NOT NULL GROUP BY 1) SELECT feature, CASE WHEN days < 10 THEN 'INSUFFICIENT' WHEN abs(m) / nullif(sd, 0) < 0.05 THEN 'NO_SIGNAL' WHEN abs(m) / nullif(sd, 0) > 0.3 THEN 'PROMISING' ELSE 'WEAK' END AS class FROM s")
def classification(spark, sf):
    s = E.ic_summary(E.daily_ic(scored(spark, sf), ret="fwd", least=5))
    return s.select("feature", F.when(F.col("days") < 10, "INSUFFICIENT").when(F.abs("ir") < 0.05, "NO_SIGNAL").when(F.abs("ir") > 0.3, "PROMISING").otherwise("WEAK").alias("class"))


@query("DOM_45_rolling_weights", f"{EVAL}, i AS (SELECT feature, trade_date, rank_ic FROM ic WHERE ic IS NOT NULL), w AS (SELECT feature, trade_date, CASE WHEN count(rank_ic) OVER v = 5 THEN greatest(0, avg(rank_ic) OVER v) END AS w FROM i WINDOW v AS (PARTITION BY feature ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING)) SELECT feature, trade_date, round(w / nullif(sum(w) OVER (PARTITION BY trade_date), 0), 4) AS weight FROM w")
def rolling_weights(spark, sf):
    d = E.daily_ic(scored(spark, sf), ret="fwd", least=5)
    v = Window.partitionBy("feature").orderBy("trade_date").rowsBetween(-7, -3)
    w = d.withColumn("w", F.when(F.count("rank_ic").over(v) == 5, F.greatest(F.lit(0.0), F.avg("rank_ic").over(v))))
    return w.select("feature", "trade_date", F.round(C.ratio("w", F.sum("w").over(Window.partitionBy("trade_date"))), 4).alias("weight"))


@query("DOM_53_trade_outcomes", f"""{B}, f AS (SELECT symbol, trade_date, lead(open) {BY}) AS entry, lead(close, 3) {BY}) AS x, min(low) {BY} ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS lo FROM bars_b), o AS (SELECT CASE WHEN entry IS NULL OR x IS NULL THEN 'UNTRADABLE' WHEN lo <= entry * 0.5 THEN 'STOPPED' ELSE 'HELD' END AS outcome, CASE WHEN entry IS NULL OR x IS NULL THEN NULL WHEN lo <= entry * 0.5 THEN -0.5 - 0.003 ELSE x / nullif(entry, 0) - 1 - 0.003 END AS net FROM f) SELECT outcome, count(*) AS n, round(avg(net), 5) AS net FROM o GROUP BY 1""")
def trade_outcomes(spark, sf):
    f = V.bars_b(spark, sf).select(F.lead("open").over(T.SYMBOL).alias("entry"), F.lead("close", 3).over(T.SYMBOL).alias("x"), F.min("low").over(T.SYMBOL.rowsBetween(2, 3)).alias("lo"))
    dead, hit = F.col("entry").isNull() | F.col("x").isNull(), F.col("lo") <= F.col("entry") * 0.5
    o = f.select(F.when(dead, "UNTRADABLE").when(hit, "STOPPED").otherwise("HELD").alias("outcome"), F.when(dead, None).when(hit, -0.503).otherwise(C.ratio("x", "entry") - 1 - 0.003).alias("net"))
    return o.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("net"), 5).alias("net"))


@query("DOM_64_manifest", """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), have AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS d FROM events WHERE value > 480) SELECT t.event_type AS source, count(h.d) AS complete, count(*) - count(h.d) AS missing, count(*) = count(h.d) AS ready FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN days LEFT JOIN have h ON h.event_type = t.event_type AND h.d = days.d GROUP BY 1""")
def manifest(spark, sf):
    e = V.read(spark, sf, "events").select("event_type", F.to_date("ts").alias("d"), "value")
    have = e.where("value > 480").select("event_type", "d", F.lit(1).alias("ok")).distinct()
    grid = e.select("event_type").distinct().crossJoin(F.broadcast(e.select("d").distinct()))  # days
    j = grid.join(have, ["event_type", "d"], "left")
    return j.groupBy(F.col("event_type").alias("source")).agg(F.count("ok").alias("complete"), F.count_if(F.col("ok").isNull()).alias("missing"), (F.count("*") == F.count("ok")).alias("ready"))


@query("DOM_68_verification", """WITH x AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles, max(length(text)) AS longest FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN roles >= 2 AND n >= 4 THEN 'VERIFIED' WHEN roles >= 2 THEN 'PARTIAL' ELSE 'UNVERIFIED' END AS status, round(CASE WHEN roles >= 2 AND n >= 4 THEN 1.0 WHEN roles >= 2 THEN 0.6 ELSE 0.25 END, 4)::DOUBLE AS weight FROM x""")
def verification(spark, sf):
    x = V.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles"))
    status = F.when((F.col("roles") >= 2) & (F.col("n") >= 4), "VERIFIED").when(F.col("roles") >= 2, "PARTIAL").otherwise("UNVERIFIED")
    return x.withColumn("status", status).select("conv_id", "status", F.when(F.col("status") == "VERIFIED", 1.0).when(F.col("status") == "PARTIAL", 0.6).otherwise(0.25).alias("weight"))


@query("DOM_70_liquidity", f"""{B}, k AS (SELECT symbol, trade_date, (rank() OVER (PARTITION BY trade_date ORDER BY amount))::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS pct FROM bars_b) SELECT trade_date, count(*) FILTER (WHERE pct > 0.8) AS high, count(*) FILTER (WHERE pct > 0.3 AND pct <= 0.8) AS normal, count(*) FILTER (WHERE pct <= 0.3) AS low FROM k GROUP BY 1""")
def liquidity(spark, sf):
    by = Window.partitionBy("trade_date")
    k = V.bars_b(spark, sf).select("trade_date", (F.rank().over(by.orderBy("amount")) / F.count("*").over(by)).alias("pct"))
    c = lambda e: F.count_if(F.expr(e))
    return k.groupBy("trade_date").agg(c("pct > 0.8").alias("high"), c("pct > 0.3 AND pct <= 0.8").alias("normal"), c("pct <= 0.3").alias("low"))


@query("DOM_75_variants", f"""{B}, {RETS}, k AS (SELECT trade_date, symbol, lead(ret) {BY}) AS fwd, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, symbol) AS b, count(*) OVER (PARTITION BY trade_date) AS n FROM rets), v AS (SELECT trade_date, fwd, n, a, row_number() OVER (PARTITION BY trade_date ORDER BY a + b, symbol) AS c FROM k), u AS (SELECT fwd, unnest([{{'v': 'A', 'ok': a <= greatest(1, ceil(n * 0.1))}}, {{'v': 'C', 'ok': c <= greatest(1, ceil(n * 0.1))}}]) AS e FROM v) SELECT e.v AS variant, count(fwd) AS n, round(avg(fwd), 5) AS mean FROM u WHERE e.ok GROUP BY 1""")
def variants(spark, sf):
    by = Window.partitionBy("trade_date")
    place = lambda *o: F.row_number().over(by.orderBy(*o, "symbol"))
    k = rets(spark, sf).withColumns({"fwd": F.lead("ret").over(T.SYMBOL), "a": place(F.desc("amount")), "b": place(F.desc("volume")), "n": F.count("*").over(by)})
    k = k.withColumn("c", place(F.col("a") + F.col("b")))
    cut = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))
    return k.select("fwd", F.explode(C.flags(A=F.col("a") <= cut, C=F.col("c") <= cut)).alias("variant")).groupBy("variant").agg(F.count("fwd").alias("n"), F.round(F.avg("fwd"), 5).alias("mean"))
