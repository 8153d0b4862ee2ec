"""Queries of projections, windows and time-series features over derived bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import pit
from asoflab.operators import timeseries as T
from asoflab.plans.registry import query
from asoflab.sources import views as V

BY = "OVER (PARTITION BY symbol ORDER BY trade_date"
A, B = V.ctes("bars_a"), V.ctes("bars_b")


def r(df: DataFrame, keys: list[str], digits: int = 6, **values) -> DataFrame:
    """Keys and rounded values: sums of doubles don't depend on their order then."""
    return df.select(*keys, *[F.round(v, digits).alias(n) for n, v in values.items()])


PATH = f"""path AS (SELECT *, lag(close) {BY}) AS pc, lag(volume) {BY}) AS pv FROM bars_a)"""


@query("PRJ_3_path_features", f"""{A}, {PATH}
SELECT symbol, trade_date, round((close - pc) / nullif(pc, 0), 6) AS ret, round((open - pc) / nullif(pc, 0), 6) AS open_gap, round((close - open) / nullif(open, 0), 6) AS intraday,
  round((high - low) / nullif(pc, 0), 6) AS amplitude, round((close - low) / nullif(high - low, 0), 6) AS close_location, round((close - high) / nullif(high, 0), 6) AS high_to_close,
  round((close - low) / nullif(low, 0), 6) AS low_to_close, round((volume - pv) / nullif(pv, 0), 6) AS volume_change FROM path""")
def path_features(spark: SparkSession, sf: str) -> DataFrame:
    df = T.path_features(V.bars_a(spark, sf))
    return r(df, ["symbol", "trade_date"], **{c: F.col(c) for c in ("ret", "open_gap", "intraday", "amplitude", "close_location", "high_to_close", "low_to_close", "volume_change")})


@query("PRJ_4_limit_flags", f"""{A}, {PATH} SELECT symbol, trade_date,
  CASE WHEN pc IS NULL THEN NULL ELSE close >= pc * 1.1 * 0.999 END AS limit_up, CASE WHEN pc IS NULL THEN NULL ELSE close <= pc * 0.9 * 1.001 END AS limit_down,
  CASE WHEN pc IS NULL THEN NULL ELSE high >= pc * 1.1 * 0.999 AND close < pc * 1.1 * 0.999 END AS broken FROM path""")
def limit_flags(spark, sf):
    df = V.bars_a(spark, sf).withColumn("pc", F.lag("close").over(T.SYMBOL))
    up, down = F.col("pc") * 1.1 * 0.999, F.col("pc") * 0.9 * 1.001
    return df.select("symbol", "trade_date", (F.col("close") >= up).alias("limit_up"), (F.col("close") <= down).alias("limit_down"), ((F.col("high") >= up) & (F.col("close") < up)).alias("broken"))


@query("PRJ_5_gap_split", f"""{A}, {PATH}, s AS (SELECT *, sign((open - pc) / nullif(pc, 0)) * (close - open) / nullif(open, 0) AS along FROM path)
SELECT symbol, trade_date, CASE WHEN along IS NOT NULL THEN round(greatest(along, 0), 6) ELSE 0 END AS follow, CASE WHEN along IS NOT NULL THEN round(greatest(-along, 0), 6) ELSE 0 END AS fade FROM s""")
def gap_split(spark, sf):
    df = T.path_features(V.bars_a(spark, sf))
    follow, fade = T.gap_split("open_gap", "intraday")
    return r(df, ["symbol", "trade_date"], follow=follow, fade=fade)


@query("PRJ_9_buckets", f"""{A}, {PATH}, s AS (SELECT (close - pc) / nullif(pc, 0) * 100 AS x FROM path)
SELECT CASE WHEN x IS NULL THEN 'NONE' WHEN x > 7 THEN 'OVER_7' WHEN x > 5 THEN '5_7' WHEN x > 2 THEN '2_5' WHEN x >= 0 THEN '0_2' ELSE 'DOWN' END AS bucket, count(*) AS n FROM s GROUP BY 1""")
def buckets(spark, sf):
    x = F.col("ret") * 100
    bucket = F.when(x.isNull(), "NONE").when(x > 7, "OVER_7").when(x > 5, "5_7").when(x > 2, "2_5").when(x >= 0, "0_2").otherwise("DOWN")
    return T.path_features(V.bars_a(spark, sf)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("PRJ_1_units", """SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity * CASE l_returnflag WHEN 'R' THEN 100 WHEN 'A' THEN 10000 ELSE 0.01 END), 4) AS amount, count(*) AS n
FROM lineitem GROUP BY ALL""")
def units(spark, sf):
    unit = F.when(F.col("l_returnflag") == "R", "LOTS").when(F.col("l_returnflag") == "A", "TEN_THOUSAND")
    rows = V.read(spark, sf, "lineitem").withColumn("unit", unit)
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.round(F.sum(C.in_base_units("l_quantity", "unit", F.lit("PERCENT"))), 4).alias("amount"), F.count("*").alias("n"))


@query("PRJ_2_symbols", r"""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'none' ELSE 'sh' || lpad((s_suppkey * 7919 % 1000000)::VARCHAR, 6, '0') END AS code FROM supplier),
d AS (SELECT *, nullif(regexp_extract(upper(code), '(\d{6})', 1), '') AS digits FROM s)
SELECT s_suppkey, digits, CASE WHEN regexp_matches(digits, '^(6|9)') THEN 'SH' WHEN regexp_matches(digits, '^(0|2|3)') THEN 'SZ' WHEN regexp_matches(digits, '^(4|8)') THEN 'BJ' END AS exchange,
CASE WHEN starts_with(digits, '688') THEN 'STAR' WHEN starts_with(digits, '30') THEN 'CHINEXT' WHEN regexp_matches(digits, '^(4|8)') THEN 'BSE' WHEN digits IS NOT NULL THEN 'MAIN' END AS board FROM d""")
def symbols(spark, sf):
    code = F.when(F.col("s_suppkey") % 7 == 0, "none").otherwise(F.concat(F.lit("sh"), F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0")))
    digits, exchange, board = C.symbol_parts(code)
    return V.read(spark, sf, "supplier").select("s_suppkey", digits.alias("digits"), exchange.alias("exchange"), board.alias("board"))


@query("PRJ_7_quality_states", f"""{A}, {PATH} SELECT CASE WHEN pc IS NULL THEN 'MISSING' WHEN high = low THEN 'NOT_APPLICABLE' ELSE 'VALID' END AS state, count(*) AS n FROM path GROUP BY 1""")
def quality_states(spark, sf):
    state = F.when(F.col("previous_close").isNull(), "MISSING").when(F.col("high") == F.col("low"), "NOT_APPLICABLE").otherwise("VALID")
    return T.path_features(V.bars_a(spark, sf)).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("PRJ_8_sessions", """SELECT CASE WHEN dayofweek(ts) IN (0, 6) THEN 'NON_TRADING_DAY' WHEN strftime(ts, '%H:%M') < '09:30' THEN 'PRE_MARKET' WHEN strftime(ts, '%H:%M') <= '15:00' THEN 'IN_SESSION' ELSE 'POST_MARKET' END AS session,
count(*) AS n FROM events GROUP BY 1""")
def sessions(spark, sf):
    events = V.read(spark, sf, "events")
    session = C.session_of(F.date_format("ts", "HH:mm"), ~F.dayofweek("ts").isin(1, 7))
    return events.groupBy(session.alias("session")).agg(F.count("*").alias("n"))


@query("PRJ_10_reason_codes", f"""{A}, {PATH}, s AS (SELECT symbol, trade_date, list_filter([CASE WHEN (close - pc) / nullif(pc, 0) > 0.05 THEN 'SURGE' END, CASE WHEN (close - pc) / nullif(pc, 0) < -0.05 THEN 'DROP' END,
  CASE WHEN volume > 2 * pv THEN 'VOLUME' END, CASE WHEN close = high THEN 'STRONG_CLOSE' END], lambda x: x IS NOT NULL) AS codes FROM path)
SELECT symbol, trade_date, array_to_string(codes, ',') AS codes, len(codes) AS n FROM s""")
def reason_codes(spark, sf):
    df = T.path_features(V.bars_a(spark, sf))
    codes = C.flags(SURGE=F.col("ret") > 0.05, DROP=F.col("ret") < -0.05, VOLUME=F.col("volume") > 2 * F.col("previous_volume"), STRONG_CLOSE=F.col("close") == F.col("high"))
    return df.select("symbol", "trade_date", F.array_join(codes, ",").alias("codes"), F.size(codes).cast("long").alias("n"))


@query("PRJ_11_top_factors", f"""{A}, {PATH}, f AS (SELECT symbol, trade_date, unnest([{{'v': (close - pc) / nullif(pc, 0), 'n': 'ret'}}, {{'v': (open - pc) / nullif(pc, 0), 'n': 'gap'}}, {{'v': (close - open) / nullif(open, 0), 'n': 'intraday'}}, {{'v': (volume - pv) / nullif(pv, 0), 'n': 'volume'}}]) AS x FROM path),
p AS (SELECT symbol, trade_date, x.n AS n, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY x.v DESC, x.n DESC) AS k FROM f WHERE x.v > 0)
SELECT symbol, trade_date, string_agg(n, ',' ORDER BY k) AS positive FROM p WHERE k <= 3 GROUP BY 1, 2""")
def top_factors(spark, sf):
    df = T.path_features(V.bars_a(spark, sf))
    every = F.array(*[F.struct(F.col(c).alias("v"), F.lit(n).alias("n")) for c, n in (("ret", "ret"), ("open_gap", "gap"), ("intraday", "intraday"), ("volume_change", "volume"))])
    best = F.slice(F.reverse(F.array_sort(F.filter(every, lambda x: x["v"] > 0))), 1, 3)
    return df.where(F.size(best) > 0).select("symbol", "trade_date", F.array_join(F.transform(best, lambda x: x["n"]), ",").alias("positive"))


# Windows


REVISED = "revised AS (SELECT *, 0 AS lag_days, close AS value FROM bars_a UNION ALL SELECT *, symbol % 5 + 1, close * 1.01 FROM bars_a)"


@query("WIN_1_latest_revision", f"""{A}, {REVISED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY lag_days DESC, value) AS k FROM revised WHERE trade_date + CAST(lag_days AS INTEGER) <= DATE '2000-01-01')
SELECT symbol, trade_date, lag_days, round(value, 6) AS value FROM ranked WHERE k = 1""")
def latest_revision(spark, sf):
    bars = V.bars_a(spark, sf)
    revisions = ((F.lit(0), F.col("close")), ((F.col("symbol") % 5 + 1).cast("int"), F.col("close") * 1.01))
    revised = bars.select("symbol", "trade_date", F.inline(F.array(*[F.struct(lag.alias("lag_days"), value.alias("value")) for lag, value in revisions])))
    known = revised.where(F.date_add("trade_date", F.col("lag_days")) <= F.to_date(F.lit("2000-01-01")))
    return r(pit.latest_revision(known, ["symbol", "trade_date"], [F.desc("lag_days"), F.asc("value")]), ["symbol", "trade_date", "lag_days"], value=F.col("value"))


@query("WIN_2_last_rows", f"""{A}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars_a) SELECT symbol, trade_date, close FROM k WHERE k <= 61""")
def last_rows(spark, sf):
    return pit.last_rows(V.bars_a(spark, sf), ["symbol"], [F.desc("trade_date")], 61).select("symbol", "trade_date", "close")


RETS = f"rets AS (SELECT symbol, trade_date, close, amount, volume, (close - lag(close) {BY})) / nullif(lag(close) {BY}), 0) AS ret FROM bars_b)"


def rets(spark, sf) -> DataFrame:
    return V.bars_b(spark, sf).withColumn("ret", C.change("close", F.lag("close").over(T.SYMBOL))).select("symbol", "trade_date", "close", "amount", "volume", "ret")


MINRANK = "CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY ret ASC NULLS LAST) END"


@query("WIN_3_scaled_rank", f"""{B}, {RETS}, k AS (SELECT *, {MINRANK} AS k, count(ret) OVER (PARTITION BY trade_date) AS n FROM rets)
SELECT symbol, trade_date, round((k - 1)::DOUBLE / nullif(n - 1, 0), 6) AS unit, round((k - 1)::DOUBLE / nullif(n - 1, 0) * 2 - 1, 6) AS signed FROM k""")
def scaled_rank(spark, sf):
    return r(rets(spark, sf), ["symbol", "trade_date"], unit=C.scaled_rank("ret", "trade_date"), signed=C.scaled_rank("ret", "trade_date", signed=True))


@query("WIN_4_average_rank", f"""{B}, {RETS}, k AS (SELECT *, {MINRANK} AS k, count(*) OVER (PARTITION BY trade_date, ret) AS ties FROM rets) SELECT symbol, trade_date, k + (ties - 1) / 2.0::DOUBLE AS rank FROM k""")
def average_rank(spark, sf):
    return rets(spark, sf).select("symbol", "trade_date", C.average_rank("ret", "trade_date").alias("rank"))


@query("WIN_5_pct_rank", f"""{B}, {RETS}, k AS (SELECT *, {MINRANK} AS k, count(*) OVER (PARTITION BY trade_date, ret) AS ties, count(ret) OVER (PARTITION BY trade_date) AS n FROM rets)
SELECT symbol, trade_date, round((k + (ties - 1) / 2.0::DOUBLE) / n, 6) AS pct FROM k""")
def pct_rank(spark, sf):
    return r(rets(spark, sf), ["symbol", "trade_date"], pct=C.pct_rank("ret", "trade_date"))


@query("WIN_6_percent_rank", f"""{B}, {RETS} SELECT symbol, trade_date, round(percent_rank() OVER (PARTITION BY trade_date ORDER BY ret ASC NULLS LAST), 6) AS pr FROM rets""")
def percent_rank(spark, sf):
    by = Window.partitionBy("trade_date").orderBy(F.col("ret").asc_nulls_last())
    return r(rets(spark, sf), ["symbol", "trade_date"], pr=F.percent_rank().over(by))


@query("WIN_7_quintile", f"""{B}, {RETS}, k AS (SELECT *, cume_dist() OVER (PARTITION BY trade_date ORDER BY ret) AS cd, count(DISTINCT ret) OVER (PARTITION BY trade_date) AS d FROM rets WHERE ret IS NOT NULL)
SELECT symbol, trade_date, CASE WHEN d >= 5 THEN least(5, ceil(cd * 5))::BIGINT END AS q FROM k""")
def quintile(spark, sf):
    return rets(spark, sf).where("ret IS NOT NULL").select("symbol", "trade_date", C.quintile("ret", "trade_date").cast("long").alias("q"))


@query("WIN_8_ntile", f"""{B}, {RETS} SELECT symbol, trade_date, ntile(5) OVER (PARTITION BY trade_date ORDER BY ret, symbol) AS q FROM rets WHERE ret IS NOT NULL""")
def ntile(spark, sf):
    return rets(spark, sf).where("ret IS NOT NULL").select("symbol", "trade_date", F.ntile(5).over(Window.partitionBy("trade_date").orderBy("ret", "symbol")).cast("long").alias("q"))


@query("WIN_9_dense_rank", f"""{A} SELECT symbol, trade_date, dense_rank() OVER (PARTITION BY symbol ORDER BY date_trunc('month', trade_date)) AS period FROM bars_a""")
def dense_rank(spark, sf):
    return V.bars_a(spark, sf).select("symbol", "trade_date", F.dense_rank().over(Window.partitionBy("symbol").orderBy(F.date_trunc("month", "trade_date"))).cast("long").alias("period"))


@query("WIN_10_lag_lead", f"""{A}, {V.SQL['days_a']} SELECT symbol, trade_date, trade_index, lag(close, 2) {BY}) AS before, lead(close, 3) {BY}) AS after FROM bars_a JOIN days_a USING (trade_date)""")
def lag_lead(spark, sf):
    return pit.with_trade_index(V.bars_a(spark, sf)).select("symbol", "trade_date", F.col("trade_index").cast("long").alias("trade_index"), F.lag("close", 2).over(T.SYMBOL).alias("before"), F.lead("close", 3).over(T.SYMBOL).alias("after"))


F20 = f"{BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("WIN_11_trailing", f"""{A} SELECT symbol, trade_date, CASE WHEN count(close) {F20} >= 20 THEN round(avg(close) {F20}, 6) END AS mean, CASE WHEN count(close) {F20} >= 20 THEN round(stddev_samp(close) {F20}, 4) END AS sd,
round(sum(volume) {F20}, 4) AS volume, count(close) {F20} AS n FROM bars_a""")
def trailing(spark, sf):
    w = C.trailing(T.SYMBOL, 20)
    gate = lambda v: C.full(v, F.col("close"), w, 20)
    return V.bars_a(spark, sf).select("symbol", "trade_date", F.round(gate(F.avg("close").over(w)), 6).alias("mean"), F.round(gate(F.stddev_samp("close").over(w)), 4).alias("sd"), F.round(F.sum("volume").over(w), 4).alias("volume"), F.count("close").over(w).alias("n"))


@query("WIN_12_trailing_quantile", f"""{A} SELECT symbol, trade_date, round(quantile_cont(close, 0.75) {BY} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 9) AS q75 FROM bars_a""")
def trailing_quantile(spark, sf):
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], 9, q75=F.percentile("close", F.lit(0.75)).over(T.SYMBOL.rowsBetween(-60, -1)))


@query("WIN_13_forward_extremes", f"""{A} SELECT symbol, trade_date, min(low) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS low5, max(high) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS high5, count(*) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM bars_a""")
def forward_extremes(spark, sf):
    w = T.SYMBOL.rowsBetween(1, 5)
    return V.bars_a(spark, sf).select("symbol", "trade_date", F.min("low").over(w).alias("low5"), F.max("high").over(w).alias("high5"), F.count("*").over(w).alias("n"))


P20 = f"{BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("WIN_14_breakout", f"""{A} SELECT symbol, trade_date, CASE WHEN count(*) {P20} = 20 THEN close > max(high) {P20} END AS breakout, CASE WHEN count(*) {P20} = 20 THEN close < min(low) {P20} END AS breakdown FROM bars_a""")
def breakout(spark, sf):
    w = T.SYMBOL.rowsBetween(-20, -1)
    gate = lambda c: F.when(F.count("*").over(w) == 20, c)
    return V.bars_a(spark, sf).select("symbol", "trade_date", gate(F.col("close") > F.max("high").over(w)).alias("breakout"), gate(F.col("close") < F.min("low").over(w)).alias("breakdown"))


@query("WIN_15_first_value", f"""{A} SELECT symbol, trade_date, round(close / nullif(first_value(close) {F20}, 0) - 1, 6) AS since_start FROM bars_a""")
def first_value(spark, sf):
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], since_start=C.ratio("close", F.first_value("close").over(C.trailing(T.SYMBOL, 20))) - 1)


CURVE = f"""curve AS (SELECT symbol, trade_date, exp(sum(ln(greatest(1 + ret, 1e-8))) {BY} ROWS UNBOUNDED PRECEDING)) AS nav FROM rets WHERE ret IS NOT NULL)"""


@query("WIN_16_cumulative_curve", f"""{B}, {RETS}, {CURVE} SELECT symbol, trade_date, round(ln(nav), 6) AS log_nav FROM curve""")
def cumulative_curve(spark, sf):
    nav = F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-8)))).over(T.SYMBOL.rowsBetween(Window.unboundedPreceding, 0)))
    return r(rets(spark, sf).where("ret IS NOT NULL"), ["symbol", "trade_date"], log_nav=F.ln(nav))


@query("WIN_17_drawdown", f"""{B}, {RETS}, {CURVE}, peak AS (SELECT *, max(nav) {BY} ROWS UNBOUNDED PRECEDING) AS peak FROM curve)
SELECT symbol, round(min(nav / peak - 1), 6) AS drawdown, round(min(nav / greatest(peak, 1) - 1), 6) AS drawdown_from_start FROM peak GROUP BY 1""")
def drawdown(spark, sf):
    run = T.SYMBOL.rowsBetween(Window.unboundedPreceding, 0)
    nav = rets(spark, sf).where("ret IS NOT NULL").withColumn("nav", F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-8)))).over(run)))
    peak = nav.withColumn("peak", F.max("nav").over(run))
    return peak.groupBy("symbol").agg(F.round(F.min(F.col("nav") / F.col("peak") - 1), 6).alias("drawdown"), F.round(F.min(F.col("nav") / F.greatest("peak", F.lit(1.0)) - 1), 6).alias("drawdown_from_start"))


@query("WIN_18_streaks", f"""{A}, {PATH}, m AS (SELECT symbol, trade_date, coalesce(close > pc, false) AS up, row_number() {BY}) AS n FROM path), b AS (SELECT *, max(CASE WHEN NOT up THEN n END) {BY} ROWS UNBOUNDED PRECEDING) AS last FROM m)
SELECT symbol, trade_date, n - coalesce(last, 0) AS up_days FROM b""")
def streaks(spark, sf):
    df = V.bars_a(spark, sf).withColumn("pc", F.lag("close").over(T.SYMBOL))
    return T.with_streak(df, F.col("close") > F.col("pc"), "up_days").select("symbol", "trade_date", "up_days")


@query("WIN_19_zscore", f"""{B}, {RETS} SELECT symbol, trade_date, round((ret - avg(ret) OVER (PARTITION BY trade_date)) / nullif(stddev_pop(ret) OVER (PARTITION BY trade_date), 0), 5) AS z FROM rets""")
def zscore(spark, sf):
    return r(rets(spark, sf), ["symbol", "trade_date"], 5, z=C.zscore("ret", "trade_date"))


@query("WIN_20_expanding_median", f"""{B}, m AS (SELECT trade_date, avg(close) AS x FROM bars_b GROUP BY 1) SELECT trade_date, CASE WHEN count(*) OVER w >= 20 THEN round(median(x) OVER w, 6) END AS med FROM m WINDOW w AS (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_median(spark, sf):
    days = V.bars_b(spark, sf).groupBy("trade_date").agg(F.avg("close").alias("x"))
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    return r(days, ["trade_date"], med=F.when(F.count("*").over(w) >= 20, F.percentile("x", F.lit(0.5)).over(w)))


@query("WIN_22_relative_strength", f"""{B}, s AS (SELECT symbol, trade_date, close / nullif(lag(close, 10) {BY}), 0) - 1 AS x FROM bars_b) SELECT symbol, trade_date, round(percent_rank() OVER (PARTITION BY trade_date ORDER BY x) * 100, 4) AS rps FROM s WHERE x IS NOT NULL""")
def relative_strength(spark, sf):
    s = V.bars_b(spark, sf).select("symbol", "trade_date", (C.ratio("close", F.lag("close", 10).over(T.SYMBOL)) - 1).alias("x")).where("x IS NOT NULL")
    return r(s, ["symbol", "trade_date"], 4, rps=F.percent_rank().over(Window.partitionBy("trade_date").orderBy("x")) * 100)


@query("WIN_23_rolling_compound", f"""{A}, {PATH}, g AS (SELECT symbol, trade_date, CASE WHEN pc IS NOT NULL THEN ln(greatest(close / nullif(pc, 0), 1e-8)) END AS g FROM path) SELECT symbol, trade_date, CASE WHEN count(g) OVER w >= 63 THEN round(sum(g) OVER w, 5) END AS log_return, CASE WHEN count(g) OVER w >= 63 THEN round(stddev_samp(g) OVER w, 5) END AS sd
FROM g WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def rolling_compound(spark, sf):
    g = F.ln(F.greatest(C.ratio("close", F.lag("close").over(T.SYMBOL)), F.lit(1e-8)))
    df = V.bars_a(spark, sf).withColumn("first", F.lag("close").over(T.SYMBOL).isNull()).select("symbol", "trade_date", F.when(~F.col("first"), g).alias("g"))
    w = C.trailing(T.SYMBOL, 63)
    return r(df, ["symbol", "trade_date"], 5, log_return=C.full(F.sum("g").over(w), F.col("g"), w, 63), sd=C.full(F.stddev_samp("g").over(w), F.col("g"), w, 63))


@query("WIN_24_tail_exclusion", f"""{B}, {RETS}, t AS (SELECT *, cume_dist() OVER (PARTITION BY trade_date ORDER BY ret DESC) AS cd FROM rets WHERE ret IS NOT NULL) SELECT symbol, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY ret) AS rank FROM t WHERE cd > 0.05""")
def tail_exclusion(spark, sf):
    by = Window.partitionBy("trade_date")
    t = rets(spark, sf).where("ret IS NOT NULL").withColumn("cd", F.cume_dist().over(by.orderBy(F.desc("ret")))).where("cd > 0.05")
    return t.select("symbol", "trade_date", F.rank().over(by.orderBy("ret")).cast("long").alias("rank"))


@query("WIN_25_share_not_above", f"""{A}, {V.SQL['days_a']}, n AS (SELECT *, row_number() {BY}) AS k FROM bars_a) SELECT a.symbol, a.trade_date, CASE WHEN count(b.volume) = 20 THEN round(count(*) FILTER (WHERE b.volume <= a.volume) / 20.0, 6)::DOUBLE END AS share
FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k - 20 AND a.k - 1 GROUP BY a.symbol, a.trade_date, a.volume""")
def share_not_above(spark, sf):
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], share=T.share_not_above("volume", T.SYMBOL, 20))


# Time series


@query("TS_1_moving_averages", f"""{A}, s AS (SELECT symbol, trade_date, close, {', '.join(f"CASE WHEN count(close) {BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN avg(close) {BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS sma{n}" for n in (5, 10, 20, 60))} FROM bars_a)
SELECT symbol, trade_date, round(sma5, 6) AS sma5, round(sma10, 6) AS sma10, round(sma20, 6) AS sma20, round(sma60, 6) AS sma60, close > sma20 AS above_sma20, sma5 > sma10 AND sma10 > sma20 AND sma20 > sma60 AS bullish FROM s""")
def moving_averages(spark, sf):
    df = V.bars_a(spark, sf).withColumns({f"sma{n}": C.sma("close", T.SYMBOL, n) for n in (5, 10, 20, 60)})
    stack = (F.col("sma5") > F.col("sma10")) & (F.col("sma10") > F.col("sma20")) & (F.col("sma20") > F.col("sma60"))
    return df.select("symbol", "trade_date", *[F.round(f"sma{n}", 6).alias(f"sma{n}") for n in (5, 10, 20, 60)], (F.col("close") > F.col("sma20")).alias("above_sma20"), stack.alias("bullish"))


W12, W26 = ("[" + ", ".join(f"{w!r}::DOUBLE" for w in T.ema_weights(n, 60)) + "]" for n in (12, 26))


@query("TS_2_ema_finite", f"""{A}, s AS (SELECT symbol, trade_date, list(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM bars_a) SELECT symbol, trade_date, CASE WHEN len(v) = 60 THEN round(list_dot_product(v, {W12}), 5) END AS ema12 FROM s""")
def ema_finite(spark, sf):
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], 5, ema12=T.ema_finite("close", T.SYMBOL, 12))


@query("TS_3_macd", f"""{A}, s AS (SELECT symbol, trade_date, list(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM bars_a),
m AS (SELECT symbol, trade_date, list_reduce(list_transform(v, lambda x: {{'f': x, 's': x, 'd': 0.0::DOUBLE}}), lambda a, b: {{'f': a.f * (11.0 / 13)::DOUBLE + b.f * (2.0 / 13)::DOUBLE, 's': a.s * (25.0 / 27)::DOUBLE + b.s * (2.0 / 27)::DOUBLE,
 'd': a.d * 0.8 + (a.f * (11.0 / 13)::DOUBLE + b.f * (2.0 / 13)::DOUBLE - a.s * (25.0 / 27)::DOUBLE - b.s * (2.0 / 27)::DOUBLE) * 0.2}}) AS e FROM s)
SELECT symbol, trade_date, round(e.f - e.s, 4) AS dif, round(e.d, 4) AS dea, round(2 * (e.f - e.s - e.d), 3) AS histogram FROM m""")
def macd(spark, sf):
    m = V.bars_a(spark, sf).select("symbol", "trade_date", T.history("close", T.SYMBOL, 60).alias("v")).withColumn("m", T.macd(F.col("v")))
    return m.select("symbol", "trade_date", F.round("m.dif", 4).alias("dif"), F.round("m.dea", 4).alias("dea"), F.round("m.histogram", 3).alias("histogram"))


@query("TS_3_macd_states", f"""{A}, s AS (SELECT symbol, list(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM bars_a),
m AS (SELECT symbol, list_reduce(list_transform(v, lambda x: {{'f': x, 's': x, 'd': 0.0::DOUBLE}}), lambda a, b: {{'f': a.f * (11.0 / 13)::DOUBLE + b.f * (2.0 / 13)::DOUBLE, 's': a.s * (25.0 / 27)::DOUBLE + b.s * (2.0 / 27)::DOUBLE,
 'd': a.d * 0.8 + (a.f * (11.0 / 13)::DOUBLE + b.f * (2.0 / 13)::DOUBLE - a.s * (25.0 / 27)::DOUBLE - b.s * (2.0 / 27)::DOUBLE) * 0.2}}) AS e FROM s), h AS (SELECT symbol, round(2 * (e.f - e.s - e.d), 4) AS h FROM m)
SELECT symbol, CASE WHEN h > 0 THEN 'GOLDEN' WHEN h < 0 THEN 'DEAD' ELSE 'FLAT' END AS state, count(*) AS n FROM h GROUP BY 1, 2""")
def macd_states(spark, sf):
    m = V.bars_a(spark, sf).select("symbol", T.macd(T.history("close", T.SYMBOL, 60)).alias("m"))
    return m.groupBy("symbol", F.col("m.state").alias("state")).agg(F.count("*").alias("n"))


@query("TS_4_rsi_simple", f"""{A}, d AS (SELECT symbol, trade_date, close - lag(close) {BY}) AS d FROM bars_a), g AS (SELECT symbol, trade_date, count(d) OVER w AS n, avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) OVER w AS up, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) OVER w AS down
FROM d WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT symbol, trade_date, CASE WHEN n >= 14 THEN round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) END AS rsi FROM g""")
def rsi_simple(spark, sf):
    df = V.bars_a(spark, sf).withColumn("delta", F.col("close") - F.lag("close").over(T.SYMBOL))
    return r(df, ["symbol", "trade_date"], 4, rsi=T.rsi_simple("delta", T.SYMBOL))


@query("TS_5_rsi_wilder", f"""{A}, s AS (SELECT symbol, trade_date, list(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM bars_a),
d AS (SELECT symbol, trade_date, len(v) AS n, list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) AS d FROM s),
g AS (SELECT symbol, trade_date, n, list_reduce(list_prepend({{'u': list_sum(list_transform(d[1:14], lambda x: greatest(x, 0.0::DOUBLE))) / 14, 'l': list_sum(list_transform(d[1:14], lambda x: greatest(-x, 0.0::DOUBLE))) / 14}}, list_transform(d[15:], lambda x: {{'u': x, 'l': x}})), lambda a, b: {{'u': (a.u * 13 + greatest(b.u, 0.0::DOUBLE)) / 14, 'l': (a.l * 13 + greatest(-b.l, 0.0::DOUBLE)) / 14}}) AS e FROM d WHERE n > 14)
SELECT symbol, trade_date, round(CASE WHEN n > 14 THEN CASE WHEN e.l = 0 THEN 100 ELSE 100 - 100 / (1 + e.u / e.l) END END, 3) AS rsi FROM s LEFT JOIN g USING (symbol, trade_date)""")
def rsi_wilder(spark, sf):
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], 3, rsi=T.rsi_wilder(T.history("close", T.SYMBOL, 60)))


@query("TS_6_kdj", f"""{A}, x AS (SELECT symbol, trade_date, coalesce((close - min(low) {BY} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) / nullif(max(high) {BY} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) - min(low) {BY} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0) * 100, 50) AS rsv FROM bars_a),
s AS (SELECT symbol, trade_date, list(rsv) {BY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v FROM x),
m AS (SELECT symbol, trade_date, list_reduce(list_prepend({{'k': 50.0::DOUBLE, 'd': 50.0::DOUBLE, 'r': 0.0::DOUBLE}}, list_transform(v, lambda x: {{'k': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'r': x}})), lambda a, b: {{'k': a.k * 2 / 3 + b.r / 3, 'd': a.d * 2 / 3 + (a.k * 2 / 3 + b.r / 3) / 3, 'r': 0.0::DOUBLE}}) AS e FROM s)
SELECT symbol, trade_date, round(e.k, 4) AS k, round(e.d, 4) AS d, round(3 * e.k - 2 * e.d, 4) AS j FROM m""")
def kdj(spark, sf):
    w = C.trailing(T.SYMBOL, 9)
    low, high = F.min("low").over(w), F.max("high").over(w)
    df = V.bars_a(spark, sf).withColumn("rsv", F.coalesce(C.ratio(F.col("close") - low, high - low) * 100, F.lit(50.0)))
    df = df.withColumn("e", T.kdj(T.history("rsv", T.SYMBOL, 30)))
    return r(df, ["symbol", "trade_date"], 4, k=F.col("e.k"), d=F.col("e.d"), j=F.col("e.j"))


@query("TS_7_atr", f"""{A}, {PATH} SELECT symbol, trade_date, round(avg(greatest(high - low, abs(high - pc), abs(low - pc))) {BY} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 5) AS atr FROM path""")
def atr(spark, sf):
    df = V.bars_a(spark, sf).withColumn("pc", F.lag("close").over(T.SYMBOL)).withColumn("tr", T.true_range("high", "low", "pc"))
    return r(df, ["symbol", "trade_date"], 5, atr=F.avg("tr").over(C.trailing(T.SYMBOL, 14)))


@query("TS_8_support_resistance", f"""{A} SELECT symbol, trade_date, min(low) {F20} AS support, max(high) {F20} AS resistance FROM bars_a""")
def support(spark, sf):
    w = C.trailing(T.SYMBOL, 20)
    return V.bars_a(spark, sf).select("symbol", "trade_date", F.min("low").over(w).alias("support"), F.max("high").over(w).alias("resistance"))


@query("TS_9_volatility", f"""{A}, {PATH}, g AS (SELECT symbol, trade_date, ln(close / pc) AS g FROM path) SELECT symbol, trade_date, CASE WHEN count(g) {F20} >= 20 THEN round(stddev_samp(g) {F20} * sqrt(252), 5) END AS vol FROM g""")
def volatility(spark, sf):
    df = V.bars_a(spark, sf).withColumn("log_return", F.ln(C.ratio("close", F.lag("close").over(T.SYMBOL))))
    return r(df, ["symbol", "trade_date"], 5, vol=T.volatility(T.SYMBOL))


@query("TS_11_technical_score", f"""{A}, x AS (SELECT symbol, trade_date, close, close - lag(close) {BY}) AS d FROM bars_a),
s AS (SELECT symbol, trade_date, list(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v, avg(close) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, avg(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60, count(d) {BY} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS n,
 avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) {BY} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS up, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) {BY} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS down FROM x),
t AS (SELECT *, CASE WHEN n >= 14 THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END AS rsi, least(1, greatest(-1, (m20 / nullif(m60, 0) - 1) * 12)) AS trend, least(1, greatest(-1, (list_dot_product(v, {W12}) / nullif(list_dot_product(v, {W26}), 0) - 1) * 25)) AS momentum FROM s WHERE len(v) = 60)
SELECT symbol, trade_date, CASE WHEN trend IS NOT NULL AND momentum IS NOT NULL AND rsi IS NOT NULL THEN round(least(1, greatest(-1, trend * 0.5 + momentum * 0.35 + CASE WHEN rsi > 75 THEN -0.5 ELSE least(1, greatest(-1, (rsi - 50) / 25)) END * 0.15)), 5) END AS score FROM s LEFT JOIN t USING (symbol, trade_date)""")
def technical_score(spark, sf):
    df = V.bars_a(spark, sf).withColumn("delta", F.col("close") - F.lag("close").over(T.SYMBOL))
    df = df.withColumns({"sma20": C.sma("close", T.SYMBOL, 20), "sma60": C.sma("close", T.SYMBOL, 60), "ema12": T.ema_finite("close", T.SYMBOL, 12), "ema26": T.ema_finite("close", T.SYMBOL, 26), "rsi": T.rsi_simple("delta", T.SYMBOL)})
    return r(df, ["symbol", "trade_date"], 5, score=T.technical_score("sma20", "sma60", "ema12", "ema26", "rsi"))


@query("TS_13_regime", f"""{A}, x AS (SELECT symbol, trade_date, close / nullif(lag(close, 20) {BY}), 0) - 1 AS x FROM bars_a) SELECT symbol, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x >= 0.05 THEN 'RISING' WHEN x <= -0.05 THEN 'FALLING' ELSE 'SIDEWAYS' END AS regime, count(*) AS n FROM x GROUP BY ALL""")
def regime(spark, sf):
    x = C.ratio("close", F.lag("close", 20).over(T.SYMBOL)) - 1
    named = V.bars_a(spark, sf).withColumn("x", x).withColumn("regime", F.when(F.col("x").isNull(), "UNKNOWN").when(F.col("x") >= 0.05, "RISING").when(F.col("x") <= -0.05, "FALLING").otherwise("SIDEWAYS"))
    return named.groupBy("symbol", "regime").agg(F.count("*").alias("n"))


@query("TS_14_amount_ratio", f"""{A} SELECT symbol, trade_date, CASE WHEN count(*) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN round(amount / avg(amount) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 5) END AS ratio5 FROM bars_a""")
def amount_ratio(spark, sf):
    return r(V.bars_a(spark, sf), ["symbol", "trade_date"], 5, ratio5=T.ratio_to_prior_mean("amount", T.SYMBOL, 5))


@query("TS_15_price_volume_state", f"""{A}, {PATH}, s AS (SELECT CASE WHEN close - pc > 0 THEN 'UP' WHEN close - pc < 0 THEN 'DOWN' WHEN pc IS NOT NULL THEN 'FLAT' END || '_' || CASE WHEN volume - pv > 0 THEN 'UP' WHEN volume - pv < 0 THEN 'DOWN' WHEN pv IS NOT NULL THEN 'FLAT' END AS state FROM path) SELECT state, count(*) AS n FROM s GROUP BY 1""")
def price_volume_state(spark, sf):
    df = V.bars_a(spark, sf).select((F.col("close") - F.lag("close").over(T.SYMBOL)).alias("dp"), (F.col("volume") - F.lag("volume").over(T.SYMBOL)).alias("dv"))
    return df.groupBy(F.concat(T.move_state("dp"), F.lit("_"), T.move_state("dv")).alias("state")).agg(F.count("*").alias("n"))


@query("TS_16_market_percentile", f"""{B} SELECT symbol, trade_date, round(rank() OVER (PARTITION BY trade_date ORDER BY amount) / count(*) OVER (PARTITION BY trade_date), 6) AS pct FROM bars_b""")
def market_percentile(spark, sf):
    by = Window.partitionBy("trade_date")
    return r(V.bars_b(spark, sf), ["symbol", "trade_date"], pct=F.coalesce(F.rank().over(by.orderBy("amount")) / F.count("amount").over(by), F.lit(0.0)))


@query("TS_20_overheat", f"""{A}, s AS (SELECT symbol, trade_date, avg(close) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, avg(close) {BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60, count(*) {BY} ROWS BETWEEN 64 PRECEDING AND CURRENT ROW) AS n FROM bars_a)
SELECT symbol, trade_date, CASE WHEN n = 65 THEN round(m20 / m60 - 1, 5) END AS spread, CASE WHEN n = 65 THEN round(m60 / lag(m60, 5) {BY}) - 1, 5) END AS slope FROM s""")
def overheat(spark, sf):
    df = V.bars_a(spark, sf).withColumns({"m20": F.avg("close").over(C.trailing(T.SYMBOL, 20)), "m60": F.avg("close").over(C.trailing(T.SYMBOL, 60)), "n": F.count("*").over(C.trailing(T.SYMBOL, 65))})
    gate = lambda c: F.when(F.col("n") == 65, c)
    return r(df, ["symbol", "trade_date"], 5, spread=gate(C.ratio("m20", "m60") - 1), slope=gate(C.ratio("m60", F.lag("m60", 5).over(T.SYMBOL)) - 1))


@query("TS_22_patterns", f"""{A}, s AS (SELECT symbol, trade_date, close, volume, avg(close) {BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5, avg(close) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, max(high) {P20} AS top, avg(volume) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v5, count(*) {BY} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS n FROM bars_a),
t AS (SELECT *, lag(m5) {BY}) AS p5, lag(m20) {BY}) AS p20 FROM s), u AS (SELECT unnest(list_filter([CASE WHEN m5 > m20 AND p5 <= p20 THEN 'GOLDEN_CROSS' END, CASE WHEN m5 < m20 AND p5 >= p20 THEN 'DEAD_CROSS' END, CASE WHEN close > top THEN 'BREAKOUT' END, CASE WHEN volume > 2 * v5 THEN 'VOLUME_SURGE' END], lambda x: x IS NOT NULL)) AS pattern FROM t WHERE n = 21) SELECT pattern, count(*) AS n FROM u GROUP BY 1""")
def patterns(spark, sf):
    df = V.bars_a(spark, sf).withColumns({"m5": F.avg("close").over(C.trailing(T.SYMBOL, 5)), "m20": F.avg("close").over(C.trailing(T.SYMBOL, 20)), "top": F.max("high").over(T.SYMBOL.rowsBetween(-20, -1)), "v5": F.avg("volume").over(T.SYMBOL.rowsBetween(-5, -1)), "n": F.count("*").over(C.trailing(T.SYMBOL, 21))})
    df = df.withColumns({"p5": F.lag("m5").over(T.SYMBOL), "p20": F.lag("m20").over(T.SYMBOL)}).where("n = 21")
    hits = C.flags(GOLDEN_CROSS=F.expr("m5 > m20 AND p5 <= p20"), DEAD_CROSS=F.expr("m5 < m20 AND p5 >= p20"), BREAKOUT=F.expr("close > top"), VOLUME_SURGE=F.expr("volume > 2 * v5"))
    return df.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


FACTORS = "factors AS (SELECT symbol, trade_date, (1 + 0.01 * floor(trade_index / 250)) * (1 + symbol % 3 * 0.01) AS adj_factor FROM bars_a JOIN days_a USING (trade_date) WHERE NOT (symbol % 10 = 0 AND trade_index = 500))"


@query("TS_23_forward_adjusted", f"""{V.ctes('bars_a', 'days_a')}, {FACTORS}, j AS (SELECT b.*, f.adj_factor FROM bars_a b LEFT JOIN factors f USING (symbol, trade_date)),
g AS (SELECT symbol, count(adj_factor) = count(*) AS complete, arg_max(adj_factor, trade_date) FILTER (WHERE adj_factor IS NOT NULL) AS last FROM j GROUP BY 1)
SELECT symbol, trade_date, round(close * CASE WHEN complete THEN adj_factor / last ELSE 1 END, 6) AS close, complete AS adjusted FROM j JOIN g USING (symbol)""")
def forward_adjusted(spark, sf):
    bars = pit.with_trade_index(V.bars_a(spark, sf), pit.trading_days(V.dates_a(spark, sf)))
    factors = bars.where("NOT (symbol % 10 = 0 AND trade_index = 500)").select("symbol", "trade_date", ((1 + F.floor(F.col("trade_index") / 250) * 0.01) * (1 + F.col("symbol") % 3 * 0.01)).alias("adj_factor"))
    return r(T.forward_adjusted(bars, factors), ["symbol", "trade_date", "adjusted"], close=F.col("close"))


@query("TS_24_event_intervals", """WITH e AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'S' END AS kind, o_orderkey AS event_id FROM orders),
m AS (SELECT *, (kind = 'S' AND coalesce(lag(kind) OVER (PARTITION BY symbol ORDER BY day, event_id), 'R') <> 'S') AS new FROM e),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY symbol ORDER BY day, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT symbol, min(day) FILTER (WHERE kind = 'S') AS start, min(day) FILTER (WHERE kind = 'R') AS "end" FROM i WHERE island > 0 GROUP BY symbol, island""")
def event_intervals(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "R").otherwise("S")
    return T.event_intervals(V.read(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("at"), kind.alias("kind"), F.col("o_orderkey").alias("event_id")))


@query("TS_27_anomalies", f"""{A}, {PATH}, s AS (SELECT symbol, trade_date, (close - pc) / nullif(pc, 0) AS ret, volume / nullif(avg(volume) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS vr, (open - pc) / nullif(pc, 0) AS gap FROM path),
t AS (SELECT symbol, trade_date, list_filter([CASE WHEN ret > 0.07 THEN 'SURGE' END, CASE WHEN ret < -0.07 THEN 'DROP' END, CASE WHEN vr > 2 THEN 'VOLUME_SPIKE' END, CASE WHEN vr < 0.3 THEN 'LIQUIDITY_DROP' END, CASE WHEN abs(gap) > 0.03 THEN 'GAP' END, CASE WHEN ret > 0.099 THEN 'LIMIT_UP' END], lambda x: x IS NOT NULL) AS tags FROM s)
SELECT array_to_string(tags, ',') AS tags, len(tags) >= 3 AS confluence, count(*) AS n FROM t GROUP BY ALL""")
def anomalies(spark, sf):
    df = T.path_features(V.bars_a(spark, sf)).withColumn("vr", C.ratio("volume", F.avg("volume").over(T.SYMBOL.rowsBetween(-5, -1))))
    tags = C.flags(SURGE=F.col("ret") > 0.07, DROP=F.col("ret") < -0.07, VOLUME_SPIKE=F.col("vr") > 2, LIQUIDITY_DROP=F.col("vr") < 0.3, GAP=F.abs("open_gap") > 0.03, LIMIT_UP=F.col("ret") > 0.099)
    return df.groupBy(F.array_join(tags, ",").alias("tags"), (F.size(tags) >= 3).alias("confluence")).agg(F.count("*").alias("n"))


@query("TS_29_drift", f"""{B}, {RETS}, s AS (SELECT trade_date < DATE '2024-01-16' AS old, unnest([{{'f': 'ret', 'v': ret}}, {{'f': 'amount', 'v': amount}}, {{'f': 'volume', 'v': volume}}]) AS x FROM rets),
g AS (SELECT x.f AS feature, avg(x.v) FILTER (WHERE old) AS m0, stddev_pop(x.v) FILTER (WHERE old) AS s0, avg(x.v) FILTER (WHERE NOT old) AS m1 FROM s GROUP BY 1)
SELECT feature, round((m1 - m0) / nullif(s0, 0), 4) AS drift, CASE WHEN abs((m1 - m0) / nullif(s0, 0)) >= 3 THEN 'ALERT' WHEN abs((m1 - m0) / nullif(s0, 0)) >= 1.5 THEN 'WARNING' ELSE 'NORMAL' END AS level FROM g""")
def drift(spark, sf):
    long = rets(spark, sf).withColumn("old", F.col("trade_date") < F.to_date(F.lit("2024-01-16"))).unpivot(["old"], ["ret", "amount", "volume"], "feature", "v")
    g = long.groupBy("feature").agg(F.avg(F.when(F.col("old"), F.col("v"))).alias("m0"), F.stddev_pop(F.when(F.col("old"), F.col("v"))).alias("s0"), F.avg(F.when(~F.col("old"), F.col("v"))).alias("m1"))
    d = C.ratio(F.col("m1") - F.col("m0"), "s0")
    return g.select("feature", F.round(d, 4).alias("drift"), F.when(F.abs(d) >= 3, "ALERT").when(F.abs(d) >= 1.5, "WARNING").otherwise("NORMAL").alias("level"))
