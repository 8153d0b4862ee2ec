"""Queries of walk-forward studies: purged ridge, rolling weights, candidates on a lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import pit
from asoflab.operators import walkforward as W
from asoflab.plans.features import r
from asoflab.plans.registry import query
from asoflab.sources import shared
from asoflab.sources import views as V

FACTORS = ("tech", "fund", "sent")
#: Fewest rows of a day, as the smallest test tables have two symbols; a market takes 100.
LEAST = 2
WINDOWS, SHRINKS, METHODS = (60, 120), (0.25, 0.5, 0.75), ("ROLLING_RANK_IC", "RANK_IC_IR", "STABILITY")


def _signed(x: str) -> str:
    by = "PARTITION BY trade_date"
    return f"((rank() OVER ({by} ORDER BY {x}) + (count(*) OVER ({by}, {x}) - 1) / 2.0) / count(*) OVER ({by})) * 2 - 1"


FRAME_SQL = f"""{V.ctes('bars_c', 'days_c')}, placed AS (SELECT * FROM bars_c JOIN days_c USING (trade_date)),
raw AS (SELECT symbol, trade_date, trade_index, close / nullif(lag(close, 5) OVER w, 0) - 1 AS momentum, sum(amount) OVER v AS size, volume / nullif(avg(volume) OVER v, 0) AS activity, count(*) OVER v AS n,
  close / nullif(lag(close) OVER w, 0) - 1 AS ret, trade_index - lag(trade_index) OVER w > 2 AS has_event, max(close) OVER (PARTITION BY symbol ORDER BY trade_index RANGE BETWEEN 20 FOLLOWING AND 20 FOLLOWING) / nullif(close, 0) - 1 AS ahead
  FROM placed WINDOW w AS (PARTITION BY symbol ORDER BY trade_index), v AS (PARTITION BY symbol ORDER BY trade_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
able AS (SELECT symbol, trade_date, round(momentum, 9) AS momentum, round(size, 2) AS size, round(activity, 9) AS activity, ret > 0.04 AS risk, has_event, round(ahead, 9) AS ret FROM raw WHERE momentum IS NOT NULL AND n = 5 AND ahead IS NOT NULL),
frame AS (SELECT symbol, trade_date, {_signed('momentum')} AS tech, {_signed('size')} AS fund, {_signed('activity')} AS sent, risk, has_event, ret FROM able)"""


def frame(spark, sf) -> DataFrame:
    """(symbol, trade_date, tech, fund, sent, risk, has_event, ret): signed ranks by day of momentum, size and activity; ret runs 20 sessions ahead."""
    bars = pit.with_trade_index(V.bars_c(spark, sf), pit.trading_days(V.dates_a(spark, sf)))
    w = Window.partitionBy("symbol").orderBy("trade_index")
    v = w.rowsBetween(-4, 0)
    raw = bars.select(
        "symbol", "trade_date", F.round(C.ratio("close", F.lag("close", 5).over(w)) - 1, 9).alias("momentum"), F.round(F.sum("amount").over(v), 2).alias("size"), F.round(C.ratio("volume", F.avg("volume").over(v)), 9).alias("activity"), F.count("*").over(v).alias("n"),
        (C.ratio("close", F.lag("close").over(w)) - 1 > 0.04).alias("risk"), (F.col("trade_index") - F.lag("trade_index").over(w) > 2).alias("has_event"), F.round(C.ratio(F.max("close").over(w.rangeBetween(20, 20)), "close") - 1, 9).alias("ret"),
    )
    able = raw.where("momentum IS NOT NULL AND n = 5 AND ret IS NOT NULL")
    ranks = {n: C.pct_rank(c, "trade_date", signed=True) for n, c in zip(FACTORS, ("momentum", "size", "activity"), strict=True)}
    return able.select("symbol", "trade_date", *[v.alias(n) for n, v in ranks.items()], "risk", "has_event", "ret")


@query("DOM_46_purged_ridge")
def purged_ridge(spark, sf):
    f = frame(spark, sf)
    f = f.withColumns({"y": C.pct_rank("ret", "trade_date", signed=True), "tech_sent": F.col("tech") * F.col("sent"), "fund_sent": F.col("fund") * F.col("sent"), "warned": F.col("risk").cast("double"), "event": F.col("has_event").cast("double")})
    return r(W.purged_ridge(f, ["tech", "fund", "sent", "tech_sent", "fund_sent", "warned", "event"], "y"), ["symbol", "trade_date", "block"], prediction=F.col("prediction"))


@query("DOM_46_ridge_two_features", f"""{FRAME_SQL}, y AS (SELECT *, {_signed('ret')} AS y FROM frame), places AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS place FROM (SELECT DISTINCT trade_date FROM frame)),
x AS (SELECT * FROM y JOIN places USING (trade_date)), starts AS (SELECT place AS start FROM places WHERE place >= 125 AND (place - 125) % 40 = 0),
m AS (SELECT start, count(*) AS n, avg(tech) AS m1, avg(fund) AS m2, avg(y) AS my, stddev_pop(tech) AS s1, stddev_pop(fund) AS s2, covar_pop(tech, fund) AS c12, covar_pop(tech, y) AS c1, covar_pop(fund, y) AS c2 FROM starts JOIN x ON place BETWEEN start - 125 AND start - 26 GROUP BY start),
z AS (SELECT *, n * c12 / (s1 * s2) AS o, n + 1.0 AS d, n * c1 / s1 AS t1, n * c2 / s2 AS t2 FROM m),
b AS (SELECT *, (d * t1 - o * t2) / (d * d - o * o) / s1 AS b1, (d * t2 - o * t1) / (d * d - o * o) / s2 AS b2 FROM z)
SELECT symbol, trade_date, (start - 125) // 40 AS block, round(my + b1 * (tech - m1) + b2 * (fund - m2), 6) AS prediction FROM x JOIN b ON start = place - (place - 125) % 40 WHERE place >= 125""")
def ridge_two_features(spark, sf):
    f = frame(spark, sf).withColumn("y", C.pct_rank("ret", "trade_date", signed=True))
    return r(W.purged_ridge(f, ["tech", "fund"], "y"), ["symbol", "trade_date", "block"], prediction=F.col("prediction"))


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _weights_sql() -> str:
    parts = []
    for w in WINDOWS:
        past = f"(ORDER BY trade_date ROWS BETWEEN {25 + w} PRECEDING AND 26 PRECEDING)"
        mean = {f: f"avg({f}) OVER {past}" for f in FACTORS}
        sd = {f: f"stddev_samp({f}) OVER {past}" for f in FACTORS}
        raw = {"ROLLING_RANK_IC": lambda f: mean[f], "RANK_IC_IR": lambda f: f"coalesce({mean[f]} / nullif({sd[f]}, 0), 0)", "STABILITY": lambda f: f"{mean[f]} / (1 + coalesce(nullif({sd[f]}, 0), 1))"}
        parts += [f"SELECT trade_date, k, '{m}' AS method, {w} AS wide, {', '.join(f'greatest(coalesce({v(f)}, 0), 0) AS {f}' for f in FACTORS)} FROM (SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS k FROM ic)" for m, v in raw.items()]
    mixed = lambda f, b: f"shrink * {b} + (1 - shrink) * CASE WHEN tech + fund + sent > 0 THEN {f} / (tech + fund + sent) ELSE {b} END"
    clipped = ", ".join(f"greatest({lo}, least({hi}, {mixed(f, b)})) AS {f}" for f, b, lo, hi in zip(FACTORS, W.BASELINE, W.LOWER, W.UPPER, strict=True))
    return f"""{FRAME_SQL}, ranked AS (SELECT *, (rank() OVER (PARTITION BY trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) AS rr FROM frame),
ic AS (SELECT trade_date, {', '.join(f'CASE WHEN count(*) >= {LEAST} THEN {_corr(f, "rr")} END AS {f}' for f in FACTORS)} FROM ranked GROUP BY 1),
raws AS ({' UNION ALL '.join(parts)}), held AS (SELECT trade_date, method, wide, shrink, {clipped} FROM (SELECT *, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS shrink FROM raws WHERE k >= 25 + wide)),
dynamic AS (SELECT trade_date, method, wide, shrink, {', '.join(f'{f} / (tech + fund + sent) AS {f}' for f in FACTORS)} FROM held)"""


def dynamic_weights(f: DataFrame) -> DataFrame:
    return W.rolling_weights(W.factor_ic(f, FACTORS, "ret", LEAST), FACTORS, WINDOWS, SHRINKS)


@query("DOM_45_dynamic_weights", f"{_weights_sql()} SELECT trade_date, method, wide AS \"window\", shrink, {', '.join(f'round({f}, 6) AS {f}' for f in FACTORS)} FROM dynamic")
def dynamic_weights_query(spark, sf):
    d = dynamic_weights(frame(spark, sf))
    return d.select("trade_date", "method", "window", "shrink", *[F.round(F.col("weights")[k], 6).alias(f) for k, f in enumerate(FACTORS)])


def definitions() -> list[tuple[str, str, dict[str, float]]]:
    """(candidate, family, params): a lattice of static weights, risk overlays, and dynamic weights by method, window and shrinkage."""
    out = [("LEGACY", "LEGACY", {"tech": 0.6, "fund": 0.4, "sent": 0.0})]
    for s in (0, 1, 2, 3):
        for f in (2, 3, 4, 5):
            t = 10 - s - f
            if t >= 3.5:
                out.append((f"STATIC_{t}_{f}_{s}", "STATIC", {"tech": t / 10, "fund": f / 10, "sent": s / 10}))
    out += [(f"RISK_{p}_{c}", "RISK_OVERLAY", {"penalty": p / 100, "scale": c / 100}) for p in (10, 20) for c in (50, 75)]
    for k, m in enumerate(METHODS):
        for w in WINDOWS:
            for s in SHRINKS:
                out.append((f"DYNAMIC_{m}_{w}_{int(s * 100)}", "DYNAMIC", {"method": float(k), "window": float(w), "shrink": s}))
            if m == "RANK_IC_IR":
                out.append((f"DYNAMIC_RISK_{m}_{w}_50", "DYNAMIC_RISK", {"method": float(k), "window": float(w), "shrink": 0.5, "penalty": 0.2, "scale": 0.5}))
    return out


DEFINITIONS = definitions()
#: What makes two candidates of a family neighbours.
AXES = {
    "STATIC": {n: ("total", 0.2) for n in FACTORS}, "DYNAMIC": {"method": ("same", 0.0), "window": ("each", 60.0), "shrink": ("each", 0.25)},
    "DYNAMIC_RISK": {"method": ("same", 0.0), "window": ("each", 60.0), "shrink": ("each", 0.25)},
}


def defined(spark) -> DataFrame:
    return spark.createDataFrame(DEFINITIONS, "candidate string, family string, params map<string,double>")


def days(spark, sf) -> tuple[DataFrame, DataFrame]:
    """W.scored_days of the frame, a row for each candidate and date that is read several times, and the frame's dates with their places."""
    shared.checkpoint_dir(spark)
    f, d = frame(spark, sf).select("trade_date", *FACTORS, "risk", "ret").checkpoint(), defined(spark)  # weights need the frame's own days first
    p = lambda name, other: F.coalesce(F.col("params")[name], F.lit(other))
    fixed = d.where("family IN ('LEGACY', 'STATIC', 'RISK_OVERLAY')").select("candidate", F.array(p("tech", 0.6), p("fund", 0.4), p("sent", 0.0)).alias("weights"), p("penalty", 0.0).alias("penalty"), p("scale", 1.0).alias("risk_scale"))
    own = d.where("family LIKE 'DYNAMIC%'").select("candidate", F.element_at(F.array(*map(F.lit, METHODS)), F.col("params")["method"].cast("int") + 1).alias("method"), F.col("params")["window"].cast("int").alias("window"), F.col("params")["shrink"].alias("shrink"), p("penalty", 0.0).alias("penalty"), p("scale", 1.0).alias("risk_scale"))
    moving = dynamic_weights(f).join(F.broadcast(own), ["method", "window", "shrink"]).select("candidate", "trade_date", "weights", "penalty", "risk_scale")
    dates = W.date_places(f)
    weights = dates.drop("place").join(F.broadcast(fixed)).select(moving.columns).unionByName(moving)
    return W.scored_days(f, weights, FACTORS, "risk").checkpoint(), dates


def _scored_sql() -> str:
    row = lambda c, family, p: f"('{c}', '{family}', {p.get('tech', 0.6)}, {p.get('fund', 0.4)}, {p.get('sent', 0.0)}, {p.get('penalty', 0.0)}, {p.get('scale', 1.0)}, '{METHODS[int(p.get('method', 0))]}', {int(p.get('window', 0))}, {p.get('shrink', 0.0)})"
    values = ", ".join(row(*d) for d in DEFINITIONS)
    score = "round(w1 * tech + w2 * fund + w3 * sent - penalty * risk::INT, 9)"
    return f"""{_weights_sql()}, defined AS (SELECT candidate, family, w1::DOUBLE AS w1, w2::DOUBLE AS w2, w3::DOUBLE AS w3, penalty::DOUBLE AS penalty, scale::DOUBLE AS scale, method, wide, shrink::DOUBLE AS shrink FROM (VALUES {values}) t(candidate, family, w1, w2, w3, penalty, scale, method, wide, shrink)),
scored AS (SELECT candidate, symbol, trade_date, {score} AS score, ret, CASE WHEN risk THEN scale ELSE 1.0 END AS scale FROM frame CROSS JOIN defined WHERE family IN ('LEGACY', 'STATIC', 'RISK_OVERLAY')
  UNION ALL SELECT candidate, symbol, trade_date, round(v.tech * f.tech + v.fund * f.fund + v.sent * f.sent - penalty * risk::INT, 9), ret, CASE WHEN risk THEN scale ELSE 1.0 END FROM frame f JOIN dynamic v USING (trade_date) JOIN defined d USING (method, wide, shrink) WHERE family LIKE 'DYNAMIC%')"""


def _evaluated(source: str, keys: str, mark: str, costs: str) -> str:
    """Common table expressions days_, nets_ and metrics_ of scored rows by keys."""
    by = f"PARTITION BY {keys}, trade_date"
    rank = lambda x: f"(rank() OVER ({by} ORDER BY {x}) + (count(*) OVER ({by}, {x}) - 1) / 2.0) / count(*) OVER ({by})"
    return f"""work_{mark} AS (SELECT *, {rank('score')} AS s, {rank('ret')} AS rr FROM {source} WHERE score IS NOT NULL AND ret IS NOT NULL),
grouped_{mark} AS (SELECT {keys}, trade_date, count(*) AS n, {_corr('score', 'ret')} AS ic, {_corr('s', 'rr')} AS rank_ic, avg(ret) FILTER (s > 0.9) - avg(ret) FILTER (s <= 0.1) AS spread, count(*) FILTER (s > 0.9) AS selected, avg(ret * scale) FILTER (s > 0.9) AS gross, avg(scale) FILTER (s > 0.9) AS exposure FROM work_{mark} GROUP BY ALL),
days_{mark} AS (SELECT *, place % 20 = 0 AND selected > 0 AS traded FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY trade_date) - 1 AS place FROM grouped_{mark}) WHERE n >= {LEAST}),
nets_{mark} AS (SELECT *, gross - exposure * cost_bp / 10000.0 AS net, ln(greatest(1 + gross - exposure * cost_bp / 10000.0, 1e-8)) AS lg FROM (SELECT *, unnest({costs}) AS cost_bp FROM days_{mark} WHERE traded)),
paths_{mark} AS (SELECT *, value / greatest(1, max(value) OVER (PARTITION BY {keys}, cost_bp ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - 1 AS fall FROM (SELECT *, exp(sum(lg) OVER (PARTITION BY {keys}, cost_bp ORDER BY trade_date)) AS value FROM nets_{mark})),
own_{mark} AS (SELECT {keys}, sum(n)::BIGINT AS observations, count(*) AS valid_dates, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(252) AS ic_ir, avg(spread) AS spread FROM days_{mark} GROUP BY ALL),
stats_{mark} AS (SELECT {keys}, cost_bp, count(*) AS periods, sum(selected)::BIGINT AS trades, avg(net) AS mean_return, min(fall) AS max_drawdown, avg((net > 0)::INT) AS win_rate, sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0) AS profit_factor, quantile_cont(net, 0.05) AS tail_loss, avg(exposure) AS turnover,
  exp(sum(lg) * 12.6 / count(*)) - 1 AS annualized_return, avg(net) / nullif(stddev_samp(net), 0) * sqrt(12.6) AS sharpe, avg(net) / nullif(stddev_samp(net) FILTER (net < 0), 0) * sqrt(12.6) AS sortino FROM paths_{mark} GROUP BY ALL),
months_{mark} AS (SELECT {keys}, cost_bp, avg((l > 0)::INT) AS monthly_stability FROM (SELECT {keys}, cost_bp, date_trunc('month', trade_date) AS p, sum(lg) AS l FROM paths_{mark} GROUP BY ALL) GROUP BY ALL),
years_{mark} AS (SELECT {keys}, cost_bp, avg((l > 0)::INT) AS yearly_stability FROM (SELECT {keys}, cost_bp, year(trade_date) AS p, sum(lg) AS l FROM paths_{mark} GROUP BY ALL) GROUP BY ALL),
metrics_{mark} AS (SELECT *, annualized_return / nullif(abs(max_drawdown), 0) AS calmar FROM own_{mark} JOIN stats_{mark} USING ({keys}) JOIN months_{mark} USING ({keys}, cost_bp) JOIN years_{mark} USING ({keys}, cost_bp))"""


METRICS = ("ic", "rank_ic", "ic_ir", "spread", "mean_return", "max_drawdown", "win_rate", "profit_factor", "tail_loss", "turnover", "annualized_return", "sharpe", "sortino", "calmar", "monthly_stability", "yearly_stability")
COUNTS = ("observations", "valid_dates", "periods", "trades")
_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in METRICS)


def _told(df: DataFrame, keys: list[str], names=METRICS) -> DataFrame:
    return r(df, keys, 4, **{c: F.col(c) for c in names})


@query("DOM_47_candidate_metrics", f"{_scored_sql()}, {_evaluated('scored', 'candidate', 'e', '[0, 20, 40, 60]')} SELECT candidate, cost_bp, {', '.join(COUNTS)}, {_ROUNDED} FROM metrics_e")
def candidate_metrics(spark, sf):
    m = W.candidate_metrics(W.traded_days(days(spark, sf)[0], ["candidate"], LEAST), ["candidate"])
    return _told(m, ["candidate", "cost_bp", *COUNTS])


_NEAR = """CASE WHEN a.family = 'STATIC' THEN abs(a.w1 - b.w1) + abs(a.w2 - b.w2) + abs(a.w3 - b.w3) <= 0.2 + 1e-7 WHEN a.family LIKE 'DYNAMIC%' THEN a.method = b.method AND abs(a.wide - b.wide) <= 60 AND abs(a.shrink - b.shrink) <= 0.25 + 1e-7 ELSE true END"""
_BEST = f"""{_scored_sql()}, {_evaluated('scored', 'candidate', 'e', '[40]')}, rated AS (SELECT * FROM metrics_e JOIN defined USING (candidate)),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(sharpe, 9) DESC NULLS LAST, round(rank_ic, 9) DESC NULLS LAST, candidate) = 1)"""


@query("DOM_48_family_best", f"""{_BEST}, neighbours AS (SELECT a.family, count(*) AS neighbours, count(*) FILTER (b.sharpe >= l.sharpe + 0.15 AND b.rank_ic >= 0.02) AS passes FROM best a JOIN rated b USING (family) CROSS JOIN (SELECT sharpe FROM rated WHERE candidate = 'LEGACY') l WHERE {_NEAR} GROUP BY 1),
matched AS (SELECT DISTINCT family, trade_date FROM days_e JOIN best USING (candidate)), legacy AS (SELECT family, s.symbol, s.trade_date, s.score, s.ret, s.scale FROM scored s JOIN matched USING (trade_date) WHERE candidate = 'LEGACY'), {_evaluated('legacy', 'family', 'm', '[40]')}
SELECT family, candidate, neighbours, passes, round(passes / neighbours, 4) AS pass_ratio, round(best.sharpe, 4) AS sharpe, round(best.rank_ic, 4) AS rank_ic, metrics_m.valid_dates AS matched_dates, round(metrics_m.sharpe, 4) AS matched_sharpe, round(metrics_m.rank_ic, 4) AS matched_rank_ic, round(metrics_m.annualized_return, 4) AS matched_return
FROM best JOIN neighbours USING (family) JOIN metrics_m USING (family)""")
def family_best(spark, sf):
    d, (each, _) = defined(spark), days(spark, sf)
    m = W.candidate_metrics(W.traded_days(each, ["candidate"], LEAST), ["candidate"], (40,)).checkpoint()
    best = W.family_best(m, d)
    near = W.neighbour_passes(best, m, d, AXES, "LEGACY")
    matched = W.matched_baseline(best, each, "LEGACY", LEAST).select("family", F.col("valid_dates").alias("matched_dates"), *[F.col(c).alias(f"matched_{n}") for c, n in (("sharpe", "sharpe"), ("rank_ic", "rank_ic"), ("annualized_return", "return"))])
    out = best.select("family", "candidate", "sharpe", "rank_ic").join(near, ["family", "candidate"]).join(matched, "family")
    return _told(out, ["family", "candidate", "neighbours", "passes", "matched_dates"], ("pass_ratio", "sharpe", "rank_ic", "matched_sharpe", "matched_rank_ic", "matched_return"))


_FOLD = ("ic", "rank_ic", "spread", "mean_return", "max_drawdown", "win_rate", "annualized_return")


@query("DOM_48_fold_metrics", f"""{_BEST}, places AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS place FROM (SELECT DISTINCT trade_date FROM frame)),
folded AS (SELECT * EXCLUDE (place), (place - train_window - 25) // 40 AS fold FROM (SELECT s.*, place, unnest([60, 120]) AS train_window FROM scored s SEMI JOIN best USING (candidate) JOIN places USING (trade_date)) WHERE place >= train_window + 25), {_evaluated('folded', 'candidate, train_window, fold', 'f', '[40]')}
SELECT candidate, train_window, fold, valid_dates, periods, {', '.join(f'round({c}, 4) AS {c}' for c in _FOLD)} FROM metrics_f""")
def fold_metrics(spark, sf):
    each, dates = days(spark, sf)
    best = W.family_best(W.candidate_metrics(W.traded_days(each, ["candidate"], LEAST), ["candidate"], (40,)), defined(spark))
    own = each.join(F.broadcast(best.select("candidate")), "candidate", "left_semi")
    keys = ["candidate", "train_window", "fold"]
    m = W.candidate_metrics(W.traded_days(W.fold_days(own, dates, WINDOWS), keys, LEAST), keys, (40,))
    return _told(m, [*keys, "valid_dates", "periods"], _FOLD)
