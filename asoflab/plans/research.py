"""Queries of labels, factor evaluation, scans, composites, strategy and portfolio research."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import evaluate as E
from asoflab.operators import market as M
from asoflab.operators import optimise as O
from asoflab.operators import pit
from asoflab.operators import timeseries as T
from asoflab.operators import walkforward as W
from asoflab.plans.features import A, B, BY, FACTORS, PATH, RETS, r, rets
from asoflab.plans.registry import query
from asoflab.sources import views as V

BDAYS = V.ctes("bars_b", "days_b")
GRID = "g AS (SELECT s.symbol, d.trade_date, d.trade_index, b.open, b.close, b.low, b.high FROM (SELECT DISTINCT symbol FROM bars_b) s CROSS JOIN days_b d LEFT JOIN bars_b b ON b.symbol = s.symbol AND b.trade_date = d.trade_date)"
HORIZONS = (1, 3, 5)


def grid(spark, sf) -> DataFrame:
    bars = V.bars_b(spark, sf)
    return E.price_grid(bars, pit.trading_days(bars).select("trade_date", "trade_index"), HORIZONS)


def _labels_sql(executable: bool) -> str:
    parts = []
    for h in HORIZONS:
        out = max(h, 2) if executable else h
        entry = f"lead(open, 1) OVER w" if executable else "close"
        parts.append(f"""SELECT symbol, trade_date, {h} AS horizon, close AS c, {entry} AS entry, lead(close, {out}) OVER w AS x, lead(trade_date, {out}) OVER w AS exit_date, count(close) OVER f AS seen, min(low) OVER f AS lo, max(high) OVER f AS hi, trade_index + {out} > max(trade_index) OVER (PARTITION BY symbol) AS short
FROM g WINDOW w AS (PARTITION BY symbol ORDER BY trade_index), f AS (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)""")
    return f"""{BDAYS}, {GRID}, l AS ({' UNION ALL '.join(parts)}), s AS (SELECT *, CASE WHEN short THEN 'INSUFFICIENT_FORWARD_WINDOW' WHEN entry IS NULL THEN 'MISSING_ENTRY' WHEN x IS NULL THEN 'MISSING_EXIT' WHEN seen < horizon THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM l WHERE c IS NOT NULL)
SELECT symbol, trade_date, horizon, exit_date, status, CASE WHEN status IN ('COMPLETE', 'PARTIAL') THEN round((x - entry) / nullif(entry, 0), 6) END AS ret, CASE WHEN status IN ('COMPLETE', 'PARTIAL') THEN round((lo - entry) / nullif(entry, 0), 6) END AS mae, CASE WHEN status IN ('COMPLETE', 'PARTIAL') THEN round((hi - entry) / nullif(entry, 0), 6) END AS mfe FROM s"""


def _labels(spark, sf, executable) -> DataFrame:
    l = E.forward_labels(grid(spark, sf), HORIZONS, executable)
    return r(l, ["symbol", "trade_date", "horizon", "exit_date", "status"], ret=F.col("ret"), mae=F.col("mae"), mfe=F.col("mfe"))


@query("DOM_6_price_grid", f"""{BDAYS}, {GRID} SELECT symbol, trade_date, min(low) OVER f AS low_5, max(high) OVER f AS high_5, count(close) OVER f AS seen_5 FROM g WINDOW f AS (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def price_grid(spark, sf):
    return grid(spark, sf).select("symbol", "trade_date", "low_5", "high_5", "seen_5")


@query("DOM_7_labels_statistical", _labels_sql(False))
def labels_statistical(spark, sf):
    return _labels(spark, sf, False)


@query("DOM_7_labels_executable", _labels_sql(True))
def labels_executable(spark, sf):
    return _labels(spark, sf, True)


@query("DOM_8_excess_labels", f"""{BDAYS}, {GRID}, l AS (SELECT symbol, trade_date, close AS c, lead(close, 3) OVER w / nullif(lead(open, 1) OVER w, 0) - 1 AS ret FROM g WINDOW w AS (PARTITION BY symbol ORDER BY trade_index)) SELECT symbol, trade_date, round(ret - avg(ret) OVER (PARTITION BY trade_date), 5) AS excess FROM l WHERE c IS NOT NULL""")
def excess_labels(spark, sf):
    by = Window.partitionBy("symbol").orderBy("trade_index")
    l = grid(spark, sf).withColumn("ret", C.ratio(F.lead("close", 3).over(by), F.lead("open", 1).over(by)) - 1).where("close IS NOT NULL")
    return r(l, ["symbol", "trade_date"], 5, excess=F.col("ret") - F.avg("ret").over(Window.partitionBy("trade_date")))


@query("DOM_9_pit_audit", f"""{V.ctes('statements')} SELECT count(*) AS n, count(*) FILTER (WHERE available > period + 120) AS late_available, count(*) FILTER (WHERE available - 30 <= period) AS early_entries FROM statements""")
def pit_audit(spark, sf):
    s = V.statements(spark, sf).withColumns({"cutoff": F.date_add("period", 120), "entry": F.date_sub("available", 30)})
    return pit.violations(s, "cutoff", ["available"], "period", "entry")


EVAL = f"""{B}, {RETS}, f AS (SELECT symbol, trade_date, ret, amount, lead(ret) {BY}) AS fwd, volume FROM rets),
long AS (SELECT symbol, trade_date, fwd, unnest([{{'f': 'ret', 's': ret}}, {{'f': 'amount', 's': amount}}]) AS e FROM f),
pairs AS (SELECT symbol, trade_date, fwd, e.f AS feature, e.s AS score FROM long WHERE e.s IS NOT NULL AND fwd IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY feature, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY feature, trade_date, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY feature, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, trade_date, fwd) - 1) / 2.0::DOUBLE AS rr FROM pairs),
ic AS (SELECT feature, trade_date, count(*) AS n, covar_pop(score, fwd) / nullif(stddev_pop(score) * stddev_pop(fwd), 0) AS ic, covar_pop(rs, rr) / nullif(stddev_pop(rs) * stddev_pop(rr), 0) AS rank_ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 5)"""


def scored(spark, sf) -> DataFrame:
    x = rets(spark, sf).withColumn("fwd", F.lead("ret").over(T.SYMBOL))
    return E.stacked(x, ["symbol", "trade_date", "fwd"], ["ret", "amount"])


@query("DOM_11_daily_ic", f"{EVAL} SELECT feature, trade_date, n, round(ic, 5) AS ic, round(rank_ic, 5) AS rank_ic FROM ic WHERE ic IS NOT NULL")
def daily_ic(spark, sf):
    return r(E.daily_ic(scored(spark, sf), ret="fwd", least=5), ["feature", "trade_date", "n"], 5, ic=F.col("ic"), rank_ic=F.col("rank_ic"))


@query("DOM_12_20_ic_summary", f"{EVAL} SELECT feature, count(rank_ic) AS days, round(avg(rank_ic), 5) AS mean, round(median(rank_ic), 5) AS med, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 4) AS ir, round(avg((rank_ic > 0)::INT::DOUBLE), 5) AS positive FROM ic WHERE ic IS NOT NULL GROUP BY 1")
def ic_summary(spark, sf):
    s = E.ic_summary(E.daily_ic(scored(spark, sf), ret="fwd", least=5))
    return r(s, ["feature", "days"], 5, mean=F.col("mean"), med=F.col("median"), positive=F.col("positive")).join(s.select("feature", F.round("ir", 4).alias("ir")), "feature")


@query("DOM_13_quantile_returns", f"{EVAL}, q AS (SELECT feature, trade_date, fwd, least(5, ceil(5 * cume_dist() OVER (PARTITION BY feature, trade_date ORDER BY score)))::BIGINT AS quantile, count(*) OVER (PARTITION BY feature, trade_date) AS n FROM pairs), d AS (SELECT feature, trade_date, quantile, avg(fwd) AS ret FROM q WHERE n >= 5 GROUP BY ALL) SELECT feature, quantile, count(*) AS days, round(avg(ret), 5) AS ret FROM d GROUP BY 1, 2")
def quantile_returns(spark, sf):
    q = E.quantile_returns(scored(spark, sf), ["feature"], ret="fwd", least=5)
    return q.select("feature", F.col("quantile").cast("long").alias("quantile"), "days", F.round("ret", 5).alias("ret"))


@query("DOM_17_residual", f"""{B}, {RETS}, d AS (SELECT symbol, trade_date, ret - avg(ret) OVER p AS y, amount - avg(amount) OVER p AS a, volume - avg(volume) OVER p AS b FROM rets WHERE ret IS NOT NULL WINDOW p AS (PARTITION BY trade_date)),
m AS (SELECT *, avg(a * a) OVER p AS aa, avg(b * b) OVER p AS bb, avg(a * b) OVER p AS ab, avg(a * y) OVER p AS ay, avg(b * y) OVER p AS by FROM d WINDOW p AS (PARTITION BY trade_date))
SELECT symbol, trade_date, CASE WHEN aa * bb - ab * ab > 1e-6 THEN round(y - (bb * ay - ab * by) / nullif(aa * bb - ab * ab, 0) * a - (aa * by - ab * ay) / nullif(aa * bb - ab * ab, 0) * b, 3) END AS residual FROM m""".replace(" AS by ", ' AS "by" ').replace("ab * by)", 'ab * "by")').replace("(aa * by", '(aa * "by"'))
def residual(spark, sf):
    x = rets(spark, sf).where("ret IS NOT NULL")
    out = E.with_residual(x, "ret", "amount", "volume", ["trade_date"])
    p = Window.partitionBy("trade_date")
    flat = out.withColumns({"a": F.col("amount") - F.avg("amount").over(p), "b": F.col("volume") - F.avg("volume").over(p)})
    det = flat.withColumn("det", F.avg(F.col("a") * F.col("a")).over(p) * F.avg(F.col("b") * F.col("b")).over(p) - F.pow(F.avg(F.col("a") * F.col("b")).over(p), F.lit(2)))
    return r(det, ["symbol", "trade_date"], 3, residual=F.when(F.col("det") > 1e-6, F.col("residual")))


@query("DOM_21_q_values", """WITH t AS (SELECT o_custkey AS test, (o_custkey * 7919 % 1000) / 1000.0::DOUBLE AS p FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM t) SELECT test, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM k""")
def q_values(spark, sf):
    t = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("test")).distinct().withColumn("p_value", (F.col("test") * 7919 % 1000) / F.lit(1000.0))
    return r(E.q_values(t), ["test"], q_value=F.col("q_value"))


@query("DOM_22_bootstrap")
def bootstrap(spark, sf):
    return E.bootstrap(M.market_breadth(rets(spark, sf)).select("trade_date", "mean_return"), "mean_return", reps=300, block=5)


@query("AGG_31_corr_matrix", f"""{B}, {RETS}, x AS (SELECT ret, amount, volume, rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0::DOUBLE AS rv FROM rets)
SELECT 'amount' AS a, 'volume' AS b, count(*) AS n, round(corr(amount, volume), 5) AS pearson, round(corr(ra, rv), 5) AS spearman FROM x""")
def corr_matrix(spark, sf):
    return r(E.corr_matrix(rets(spark, sf), ["amount", "volume"]), ["a", "b", "n"], 5, pearson=F.col("pearson"), spearman=F.col("spearman"))


@query("DOM_14_group_curves", f"""{B}, {RETS}, g AS (SELECT trade_date, ret, CASE WHEN percent_rank() OVER (PARTITION BY trade_date ORDER BY amount DESC) < 0.2 THEN 'TOP' ELSE 'REST' END AS grp FROM rets WHERE ret IS NOT NULL), d AS (SELECT grp, trade_date, avg(ret) AS mean, median(ret) AS med, avg((ret > 0)::INT::DOUBLE) AS win FROM g GROUP BY 1, 2)
SELECT grp, trade_date, round(mean, 6) AS mean, round(med, 6) AS med, round(win, 6) AS win, round(sum(ln(greatest(1 + mean, 1e-8))) OVER (PARTITION BY grp ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 5) AS log_curve FROM d""")
def group_curves(spark, sf):
    x = rets(spark, sf).where("ret IS NOT NULL")
    top = F.percent_rank().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"))) < 0.2
    d = x.withColumn("grp", F.when(top, "TOP").otherwise("REST")).groupBy("grp", "trade_date").agg(F.avg("ret").alias("mean"), F.percentile("ret", F.lit(0.5)).alias("med"), F.avg((F.col("ret") > 0).cast("double")).alias("win"))
    curve = F.sum(F.ln(F.greatest(1 + F.col("mean"), F.lit(1e-8)))).over(Window.partitionBy("grp").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("grp", "trade_date", F.round("mean", 6).alias("mean"), F.round("med", 6).alias("med"), F.round("win", 6).alias("win"), F.round(curve, 5).alias("log_curve"))


COMPOSITE = f"""{B}, {RETS}, z AS (SELECT symbol, trade_date, (ret - avg(ret) OVER p) / nullif(stddev_pop(ret) OVER p, 0) AS z1, (amount - avg(amount) OVER p) / nullif(stddev_pop(amount) OVER p, 0) AS z2, (volume - avg(volume) OVER p) / nullif(stddev_pop(volume) OVER p, 0) AS z3 FROM rets WINDOW p AS (PARTITION BY trade_date))"""


@query("DOM_25_composite", f"""{COMPOSITE} SELECT symbol, trade_date, (z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT AS observed, round((coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0)) / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0), 5) AS z_mean FROM z""")
def composite(spark, sf):
    z = rets(spark, sf).withColumns({f"z_{c}": C.zscore(c, "trade_date") for c in ("ret", "amount", "volume")})
    seen = sum((F.col(f"z_{c}").isNotNull().cast("int") for c in ("ret", "amount", "volume")), F.lit(0))
    return z.select("symbol", "trade_date", seen.alias("observed"), F.round(C.weighted_mean(*[(F.col(f"z_{c}"), 1.0) for c in ("ret", "amount", "volume")]), 5).alias("z_mean"))


@query("DOM_27_cross_section", f"""{B}, {RETS}, k AS (SELECT symbol, trade_date, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY ret ASC NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2.0::DOUBLE) / count(ret) OVER p * 2 - 1 END AS a, (rank() OVER (PARTITION BY trade_date ORDER BY amount) + (count(*) OVER (PARTITION BY trade_date, amount) - 1) / 2.0::DOUBLE) / count(amount) OVER p * 2 - 1 AS b FROM rets WINDOW p AS (PARTITION BY trade_date)),
c AS (SELECT trade_date, (coalesce(a * 0.3, 0) + b * 0.7) / (CASE WHEN a IS NULL THEN 0.7 ELSE 1 END) AS score FROM k) SELECT trade_date, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.95), 6) AS p95 FROM c GROUP BY 1""")
def cross_section(spark, sf):
    k = rets(spark, sf).withColumns({"a": C.pct_rank("ret", "trade_date", signed=True), "b": C.pct_rank("amount", "trade_date", signed=True)})
    c = k.withColumn("score", C.weighted_mean((F.col("a"), 0.3), (F.col("b"), 0.7)))
    p = F.percentile("score", F.array(*[F.lit(q) for q in (0.5, 0.75, 0.9, 0.95)]))
    t = c.groupBy("trade_date").agg(p.alias("p"))
    return t.select("trade_date", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p75", "p90", "p95"))])


@query("DOM_3_scan", f"""{B}, {RETS}, w AS (SELECT symbol, trade_date, ret, amount, volume, amount / nullif(avg(amount) {BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS ar FROM rets), s AS (SELECT *, least(1, greatest(0, 0.4 * least(1, greatest(-1, coalesce(ret, 0))) + 0.4 * least(1, greatest(0, coalesce(ar, 0) / 4)) + 0.2 * least(1, greatest(0, volume / 10)) - CASE WHEN ret < -0.5 THEN 0.3 ELSE 0 END)) AS score FROM w WHERE trade_date = DATE '2024-01-20' AND volume >= 2)
SELECT symbol, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, symbol) AS place FROM s QUALIFY place <= 20""")
def scan(spark, sf):
    w = rets(spark, sf).withColumn("ar", C.ratio("amount", F.avg("amount").over(T.SYMBOL.rowsBetween(-5, -1)))).where("trade_date = DATE '2024-01-20' AND volume >= 2")
    score = C.clip(C.clip(F.coalesce("ret", F.lit(0.0))) * 0.4 + C.clip(F.coalesce(F.col("ar"), F.lit(0.0)) / 4, 0.0) * 0.4 + C.clip(F.col("volume") / 10, 0.0) * 0.2 - F.when(F.col("ret") < -0.5, 0.3).otherwise(0.0), 0.0, 1.0)
    best = w.select("symbol", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "symbol").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")).cast("long"))  # 20 rows


@query("DOM_5_replay_base", f"""{V.ctes('bars_a', 'days_a')}, {FACTORS}, {PATH} SELECT symbol, trade_date, trade_index, close, round((close - pc) / nullif(pc, 0), 6) AS ret, round(adj_factor, 6) AS adj_factor, close >= pc * 1.1 * 0.999 AS limit_up FROM path JOIN days_a USING (trade_date) LEFT JOIN factors USING (symbol, trade_date)""")
def replay_base(spark, sf):
    bars = pit.with_trade_index(V.bars_a(spark, sf), pit.trading_days(V.dates_a(spark, sf)))
    factors = bars.where("NOT (symbol % 10 = 0 AND trade_index = 500)").select("symbol", "trade_date", ((1 + F.floor(F.col("trade_index") / 250) * 0.01) * (1 + F.col("symbol") % 3 * 0.01)).alias("adj_factor"))
    x = T.path_features(bars).join(factors, ["symbol", "trade_date"], "left")
    return x.select("symbol", "trade_date", F.col("trade_index").cast("long").alias("trade_index"), "close", F.round("ret", 6).alias("ret"), F.round("adj_factor", 6).alias("adj_factor"), (F.col("close") >= F.col("previous_close") * 1.1 * 0.999).alias("limit_up"))


@query("DOM_39_event_score", """SELECT event_id, round(least(1, greatest(-1, CASE event_type WHEN 'error' THEN -1 ELSE 1 END * least(value / 100, 1) * 0.8 * pow(0.5, (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts))) / 86400 / 5))), 6) AS score FROM events""")
def event_score(spark, sf):
    age = (F.unix_timestamp(F.to_timestamp(F.lit("2024-02-01"))) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400
    s = F.when(F.col("event_type") == "error", -1).otherwise(1) * F.least(F.col("value") / 100, F.lit(1.0)) * 0.8 * F.pow(F.lit(0.5), age / 5)
    return V.read(spark, sf, "events").select("event_id", F.round(C.clip(s), 6).alias("score"))


@query("DOM_40_positions", f"""{V.ctes('trades')}, t AS (SELECT portfolio, symbol, list({{'q': CASE side WHEN 'BUY' THEN quantity ELSE -quantity END::DOUBLE, 'x': price::DOUBLE, 'c': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'f': fee::DOUBLE}} ORDER BY traded_on, trade_id) AS v FROM trades WHERE trade_id % 50 <> 0 GROUP BY 1, 2),
e AS (SELECT portfolio, symbol, list_reduce(list_prepend({{'q': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'f': 0.0::DOUBLE}}, v), lambda a, b: {{'q': a.q + b.q, 'x': b.x,
 'c': CASE WHEN a.q + b.q = 0 THEN 0 WHEN a.q * b.q >= 0 THEN (a.q * a.c + b.q * b.x) / (a.q + b.q) WHEN a.q * (a.q + b.q) > 0 THEN a.c ELSE b.x END::DOUBLE,
 'p': a.p + CASE WHEN a.q * b.q >= 0 THEN 0 ELSE least(abs(a.q), abs(b.q)) * (b.x - a.c) * sign(a.q) END::DOUBLE, 'f': a.f + b.f}}) AS e FROM t)
SELECT portfolio, symbol, round(e.q, 2) AS quantity, round(e.c, 3) AS average_cost, round(e.p, 1) AS realised, round(e.f, 4) AS fees FROM e""")
def positions(spark, sf):
    t = V.trades(spark, sf).withColumn("status", F.when(F.col("trade_id") % 50 == 0, "REVERSED"))
    return E.folded_positions(t).select("portfolio", "symbol", *[F.round(c, n).alias(c) for c, n in (("quantity", 2), ("average_cost", 3), ("realised", 1), ("fees", 4))])


@query("DOM_40_position_quantities", f"""{V.ctes('trades')} SELECT portfolio, symbol, round(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END), 2) AS quantity, round(sum(fee), 4) AS fees FROM trades WHERE trade_id % 50 <> 0 GROUP BY 1, 2""")
def position_quantities(spark, sf):
    t = V.trades(spark, sf).withColumn("status", F.when(F.col("trade_id") % 50 == 0, "REVERSED"))
    return E.folded_positions(t).select("portfolio", "symbol", F.round("quantity", 2).alias("quantity"), F.round("fees", 4).alias("fees"))


@query("DOM_41_42_fundamentals", f"""{V.ctes('statements')}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period DESC) AS k FROM statements WHERE available <= DATE '2000-06-30'), l AS (SELECT * FROM k WHERE k = 1)
SELECT l.symbol, l.period, round(l.profit / nullif(l.assets, 0), 6) AS roa, round(l.profit / nullif(l.revenue, 0), 6) AS margin, round(l.revenue / nullif(y.revenue, 0) - 1, 6) AS growth, y.symbol IS NULL AS no_comparable FROM l LEFT JOIN statements y ON y.symbol = l.symbol AND y.period = l.period - INTERVAL 1 YEAR AND y.available <= DATE '2000-06-30'""")
def fundamentals(spark, sf):
    known = V.statements(spark, sf).where("available <= DATE '2000-06-30'")
    last = pit.latest_revision(known, ["symbol"], [F.desc("period")])
    y = known.select("symbol", F.add_months("period", 12).alias("period"), F.col("revenue").alias("before"))
    j = last.join(y, ["symbol", "period"], "left")
    return r(j, ["symbol", "period"], roa=C.ratio("profit", "assets"), margin=C.ratio("profit", "revenue"), growth=C.ratio("revenue", "before") - 1).join(j.select("symbol", F.col("before").isNull().alias("no_comparable")), "symbol")


@query("DOM_49_folds", f"""{V.ctes('bars_a', 'days_a')}, f AS (SELECT trade_date, trade_index, fold, 100 + fold * 50 AS e FROM days_a CROSS JOIN range(4) t(fold)) SELECT fold, CASE WHEN trade_index <= e THEN 'TRAIN' WHEN trade_index <= e + 10 THEN 'EMBARGO' ELSE 'TEST' END AS role, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last FROM f WHERE trade_index <= e + 60 GROUP BY 1, 2""")
def folds(spark, sf):
    f = E.folds(pit.trading_days(V.bars_a(spark, sf)), 4, 100, 50, 10)
    return f.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))


@query("DOM_46_ridge")
def ridge(spark, sf):
    x = rets(spark, sf).withColumn("fwd", F.lead("ret").over(T.SYMBOL))
    return W.purged_ridge(x, ["ret", "amount", "volume"], "fwd", window=10, block=5, purge=3).select("symbol", "trade_date", F.round("prediction", 6).alias("prediction"))


@query("DOM_51_selection_rules", f"""{B}, {RETS}, k AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS amount, row_number() OVER (PARTITION BY trade_date ORDER BY ret DESC NULLS LAST, symbol) AS momentum, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, symbol) AS activity FROM rets),
u AS (SELECT symbol, trade_date, unnest([{{'r': 'AMOUNT', 'k': amount}}, {{'r': 'MOMENTUM', 'k': momentum}}, {{'r': 'ACTIVITY', 'k': activity}}]) AS e FROM k) SELECT trade_date, symbol, e.r AS rule, e.k AS place FROM u WHERE e.k <= 5""")
def selection_rules(spark, sf):
    by = Window.partitionBy("trade_date")
    place = lambda *o: F.row_number().over(by.orderBy(*o, "symbol")).cast("long")
    k = rets(spark, sf).select("symbol", "trade_date", place(F.desc("amount")).alias("AMOUNT"), place(F.col("ret").desc_nulls_last()).alias("MOMENTUM"), place(F.desc("volume")).alias("ACTIVITY"))
    return k.unpivot(["trade_date", "symbol"], ["AMOUNT", "MOMENTUM", "ACTIVITY"], "rule", "place").where("place <= 5")


@query("DOM_55_inverse_volatility", f"""{A}, {PATH}, g AS (SELECT symbol, stddev_samp((close - pc) / nullif(pc, 0)) AS sd FROM path GROUP BY 1), w AS (SELECT symbol, 1 / nullif(sd, 0) AS x FROM g) SELECT symbol, round(x / (SELECT sum(x) FROM w), 6) AS weight FROM w""")
def inverse_volatility(spark, sf):
    g = T.path_features(V.bars_a(spark, sf)).groupBy("symbol").agg(F.stddev_samp("ret").alias("sd")).select("symbol", C.ratio(F.lit(1.0), "sd").alias("x"))
    return r(g.crossJoin(F.broadcast(g.agg(F.sum("x").alias("total")))), ["symbol"], weight=C.ratio("x", "total"))  # one row of the total


ASSETS = 25  # a portfolio is 25 symbols next to each other; every symbol is in one


def optimised(spark, sf, method: str) -> DataFrame:
    x = pit.with_trade_index(rets(spark, sf)).select(F.floor(F.col("symbol") / ASSETS).alias("portfolio"), "symbol", "trade_index", "ret")
    w = O.optimised_weights(O.lookback_rows(x, window=10, step=5), [method], least=8)
    return r(w, ["portfolio", "rebalance", "symbol"], 5, weight=F.col("weight"))


@query("DOM_56_min_variance")
def min_variance(spark, sf):
    return optimised(spark, sf, "MIN_VARIANCE")


@query("DOM_56_max_sharpe")
def max_sharpe(spark, sf):
    return optimised(spark, sf, "MAX_SHARPE")


@query("DOM_56_risk_parity")
def risk_parity(spark, sf):
    return optimised(spark, sf, "HRP")


@query("DOM_57_58_segment_nav")
def segment_nav(spark, sf):
    prices = grid(spark, sf).withColumn("close", F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("trade_index").rowsBetween(Window.unboundedPreceding, 0)))
    held = prices.where("trade_index % 10 = 0 AND close IS NOT NULL").select(F.col("trade_index").alias("rebalance_index"), "symbol")
    targets = held.withColumn("weight", F.lit(0.8) / F.count("*").over(Window.partitionBy("rebalance_index")))
    return r(E.segment_nav(prices, targets, 0.001), ["trade_date"], nav=F.col("nav"))


@query("DOM_59_stress", f"""{V.ctes('bars_a', 'industries')}, w AS (SELECT symbol, sum(amount) / sum(sum(amount)) OVER () AS w FROM bars_a GROUP BY 1) SELECT sector, round(sum(w), 6) AS weight, round(sum(w * CASE sector WHEN 'ASIA' THEN -0.3 WHEN 'EUROPE' THEN -0.2 ELSE -0.1 END), 6) AS contribution FROM w JOIN industries USING (symbol) GROUP BY 1""")
def stress(spark, sf):
    w = V.bars_a(spark, sf).groupBy("symbol").agg(F.sum("amount").alias("a"))
    w = w.crossJoin(F.broadcast(w.agg(F.sum("a").alias("total")))).withColumn("w", F.col("a") / F.col("total")).join(V.industries(spark, sf), "symbol")  # one row of the total
    shock = F.when(F.col("sector") == "ASIA", -0.3).when(F.col("sector") == "EUROPE", -0.2).otherwise(-0.1)
    return w.groupBy("sector").agg(F.round(F.sum("w"), 6).alias("weight"), F.round(F.sum(F.col("w") * shock), 6).alias("contribution"))


@query("DOM_60_eligibility", f"""{A}, s AS (SELECT symbol, count(*) AS n, avg(amount) FILTER (WHERE k <= 20) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars_a WHERE trade_date <= DATE '1999-12-31') GROUP BY 1) SELECT symbol, array_to_string(list_filter([CASE WHEN n < 250 THEN 'SHORT_HISTORY' END, CASE WHEN recent < 60000 THEN 'ILLIQUID' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def eligibility(spark, sf):
    known = V.bars_a(spark, sf).where("trade_date <= DATE '1999-12-31'").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date"))))
    s = known.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.when(F.col("k") <= 20, F.col("amount"))).alias("recent"))
    return s.select("symbol", F.array_join(C.flags(SHORT_HISTORY=F.col("n") < 250, ILLIQUID=F.col("recent") < 60000), ",").alias("reasons"))


@query("DOM_61_risk_checks", f"""{V.ctes('trades')}, p AS (SELECT portfolio, symbol, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END * price) AS v FROM trades GROUP BY 1, 2), s AS (SELECT portfolio, max(v) / nullif(sum(v), 0) AS top, count(*) FILTER (WHERE v < 0) AS shorts FROM p GROUP BY 1) SELECT portfolio, CASE WHEN top IS NULL THEN 'INSUFFICIENT_DATA' WHEN shorts > 1 THEN 'VETO' WHEN top > 0.25 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s""")
def risk_checks(spark, sf):
    v = F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")) * F.col("price"))
    s = V.trades(spark, sf).groupBy("portfolio", "symbol").agg(v.alias("v")).groupBy("portfolio").agg(C.ratio(F.max("v"), F.sum("v")).alias("top"), F.count_if(F.col("v") < 0).alias("shorts"))
    return s.select("portfolio", F.when(F.col("top").isNull(), "INSUFFICIENT_DATA").when(F.col("shorts") > 1, "VETO").when(F.col("top") > 0.25, "WARN").otherwise("PASS").alias("verdict"))


@query("DOM_69_snapshot_forward", f"""{BDAYS}, s AS (SELECT symbol, trade_date, close, lead(close, 1) {BY}) AS c1, lead(close, 3) {BY}) AS c3, max(high) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS hi, min(low) {BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS lo FROM bars_b) SELECT symbol, round(c1 / nullif(close, 0) - 1, 6) AS r1, round(c3 / nullif(close, 0) - 1, 6) AS r3, round(hi / nullif(close, 0) - 1, 6) AS rise, round(lo / nullif(close, 0) - 1, 6) AS fall FROM s WHERE trade_date = DATE '2024-01-15'""")
def snapshot_forward(spark, sf):
    w = T.SYMBOL.rowsBetween(1, 5)
    s = V.bars_b(spark, sf).withColumns({"c1": F.lead("close", 1).over(T.SYMBOL), "c3": F.lead("close", 3).over(T.SYMBOL), "hi": F.max("high").over(w), "lo": F.min("low").over(w)})
    return r(s.where("trade_date = DATE '2024-01-15'"), ["symbol"], r1=C.ratio("c1", "close") - 1, r3=C.ratio("c3", "close") - 1, rise=C.ratio("hi", "close") - 1, fall=C.ratio("lo", "close") - 1)


@query("DOM_47_portfolio_metrics", f"""{B}, {RETS}, t AS (SELECT trade_date, ret, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM rets WHERE ret IS NOT NULL), d AS (SELECT trade_date, avg(ret) - 0.002 AS p FROM t WHERE k <= greatest(1, ceil(n * 0.1)) GROUP BY 1) SELECT count(*) AS days, round(avg(p) * 252, 4) AS annual, round(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252), 4) AS sharpe, round(avg((p > 0)::INT::DOUBLE), 6) AS win, round(quantile_cont(p, 0.05), 6) AS tail FROM d""")
def portfolio_metrics(spark, sf):
    by = Window.partitionBy("trade_date")
    t = rets(spark, sf).where("ret IS NOT NULL").withColumns({"k": F.row_number().over(by.orderBy(F.desc("amount"), "symbol")), "n": F.count("*").over(by)})
    d = t.where(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).groupBy("trade_date").agg((F.avg("ret") - 0.002).alias("p"))
    return d.agg(F.count("*").alias("days"), F.round(F.avg("p") * 252, 4).alias("annual"), F.round(C.ratio(F.avg("p"), F.stddev_samp("p")) * F.sqrt(F.lit(252.0)), 4).alias("sharpe"), F.round(F.avg((F.col("p") > 0).cast("double")), 6).alias("win"), F.round(F.percentile("p", F.lit(0.05)), 6).alias("tail"))


@query("DOM_54_sensitivity", f"""{B}, {RETS}, f AS (SELECT ret, lead(ret) {BY}) AS fwd FROM rets), g AS (SELECT t.threshold::DOUBLE / 10 AS threshold, fwd FROM f CROSS JOIN range(5) t(threshold) WHERE ret > t.threshold / 10.0 AND fwd IS NOT NULL) SELECT threshold, count(*) AS n, round(avg(fwd), 5) AS mean, round(count(*) FILTER (WHERE fwd > 0) / count(*), 6) AS win FROM g GROUP BY 1""")
def sensitivity(spark, sf):
    f = rets(spark, sf).withColumn("fwd", F.lead("ret").over(T.SYMBOL)).where("fwd IS NOT NULL")
    grid_ = spark.range(5).select((F.col("id") / 10).alias("threshold"))
    g = f.crossJoin(F.broadcast(grid_)).where("ret > threshold")  # five scenarios
    return g.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("fwd"), 5).alias("mean"), F.round(F.count_if(F.col("fwd") > 0) / F.count("*"), 6).alias("win"))
