"""Queries of returns by twelve dimensions, and of features' classes over four horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import slices as S
from asoflab.operators import timeseries as T
from asoflab.plans.features import B, BY, RETS, rets
from asoflab.plans.registry import query

LEAST, DATES, HORIZONS = 30, 20, (1, 2, 3, 5)

_H = ", ".join(f"{{'h': {h}, 'r': lead(close, {h}) {BY}) / nullif(close, 0) - 1}}" for h in HORIZONS)
OBSERVED_SQL = f"""{B}, {RETS}, obs AS (SELECT symbol, trade_date, CASE WHEN symbol % 7 <> 6 THEN 'B' || symbol % 4 END AS board, CASE WHEN symbol % 5 <> 4 THEN 'I' || symbol % 6 END AS industry, CASE WHEN ret IS NULL THEN 'PRICE_ONLY' ELSE 'FULL' END AS factor_coverage,
  CASE WHEN ret IS NOT NULL THEN 1 / (1 + abs(ret)) END AS sure, CASE WHEN volume > 1 THEN least(1, volume / 8) END AS score, list_filter([CASE WHEN ret >= 0.5 THEN 'PRICE_SURGE' END, CASE WHEN ret <= -0.5 THEN 'PRICE_DROP' END, CASE WHEN volume >= 3 THEN 'VOLUME_SPIKE' END], lambda x: x IS NOT NULL) AS kinds,
  coalesce(trade_date - lag(trade_date) {BY}) > 1, false) AS stale, CASE WHEN ret < -0.9 THEN 'VETO' ELSE 'CLEAR' END AS veto, CASE WHEN symbol % 9 <> 8 THEN volume < 2 END AS suspended, ret IS NOT NULL AS whole, symbol % 11 <> 10 AS pit, unnest([{_H}]) AS l FROM rets)"""


def observed(spark, sf) -> DataFrame:
    """Every symbol and day with what slices look at, and its forward returns of four horizons."""
    x = rets(spark, sf).withColumns({f"f{h}": C.ratio(F.lead("close", h).over(T.SYMBOL), "close") - 1 for h in HORIZONS} | {"stale_snapshot": F.coalesce(F.datediff("trade_date", F.lag("trade_date").over(T.SYMBOL)) > 1, F.lit(False))})
    kinds = F.array_compact(F.array(F.when(F.col("ret") >= 0.5, "PRICE_SURGE"), F.when(F.col("ret") <= -0.5, "PRICE_DROP"), F.when(F.col("volume") >= 3, "VOLUME_SPIKE")))
    coded = lambda letter, n: F.concat(F.lit(letter), (F.col("symbol") % n).cast("string"))
    return x.select(
        "symbol", "trade_date", F.when(F.col("symbol") % 7 != 6, coded("B", 4)).alias("board"), F.when(F.col("symbol") % 5 != 4, coded("I", 6)).alias("industry"), F.when(F.col("ret").isNull(), "PRICE_ONLY").otherwise("FULL").alias("factor_coverage"),
        (1 / (1 + F.abs("ret"))).alias("composite_confidence"), F.when(F.col("volume") > 1, F.least(F.lit(1.0), F.col("volume") / 8)).alias("scanner_score"), kinds.alias("anomaly_types"), "stale_snapshot", F.when(F.col("ret") < -0.9, "VETO").otherwise("CLEAR").alias("veto_status"),
        F.when(F.col("symbol") % 9 != 8, F.col("volume") < 2).alias("is_suspended"), F.col("ret").isNotNull().alias("data_complete"), (F.col("symbol") % 11 != 10).alias("point_in_time"), F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("ret")) for h in HORIZONS])).alias("l"),
    ).select("*", "l.*").drop("l").withColumn("status", F.when(F.col("ret").isNull(), "PENDING").otherwise("COMPLETE"))


@query("AGG_15_slices_of_twelve", f"""{OBSERVED_SQL}, fanned AS (SELECT l.h AS horizon, CASE WHEN pit THEN round(l.r, 6) END AS r, unnest(list_concat([{{'d': 'board', 'v': coalesce(board, 'UNKNOWN')}}, {{'d': 'industry', 'v': coalesce(industry, 'UNKNOWN')}}, {{'d': 'factor_coverage', 'v': factor_coverage}},
  {{'d': 'composite_confidence', 'v': CASE WHEN sure IS NULL THEN 'MISSING' WHEN sure < 0.4 THEN 'LOW' WHEN sure < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END}}, {{'d': 'scanner_score_quantile', 'v': CASE WHEN score IS NULL THEN 'MISSING' ELSE 'Q' || least(4, floor(score * 4)::INT + 1) END}}, {{'d': 'freshness', 'v': CASE WHEN stale THEN 'STALE' ELSE 'FRESH' END}}, {{'d': 'veto_status', 'v': veto}},
  {{'d': 'suspension', 'v': CASE WHEN suspended IS NULL THEN 'UNKNOWN' WHEN suspended THEN 'SUSPENDED' ELSE 'TRADABLE' END}}, {{'d': 'data_completeness', 'v': CASE WHEN whole THEN 'COMPLETE' ELSE 'PARTIAL' END}}, {{'d': 'trade_date_range', 'v': strftime(trade_date, '%Y-%m')}}, {{'d': 'horizon', 'v': l.h::VARCHAR}}], list_transform(CASE WHEN len(kinds) > 0 THEN kinds ELSE ['NONE'] END, lambda k: {{'d': 'anomaly_type', 'v': k}}))) AS e FROM obs)
SELECT e.d AS dimension, e.v AS slice_value, horizon, count(*) AS sample_count, count(r) AS valid_count, count(r) >= {LEAST} AS conclusion, CASE WHEN count(r) >= {LEAST} THEN round(avg(r), 5) END AS mean_return, CASE WHEN count(r) >= {LEAST} THEN round(median(r), 8) END AS median_return, CASE WHEN count(r) >= {LEAST} THEN round(avg((r > 0)::INT), 6) END AS win_rate FROM fanned GROUP BY 1, 2, 3""")
def slices(spark, sf):
    s = S.sliced_returns(observed(spark, sf), LEAST)
    return s.select("dimension", "slice_value", "horizon", "sample_count", "valid_count", "conclusion", F.round("mean_return", 5).alias("mean_return"), F.round("median_return", 8).alias("median_return"), F.round("win_rate", 6).alias("win_rate"))


def _ranked(name: str, source: str) -> str:
    """Daily rank correlations of pairs in ``source`` as the expression ``name``."""
    return f"""{name}_r AS (SELECT *, rank() OVER (PARTITION BY feature, horizon, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY feature, horizon, trade_date, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY feature, horizon, trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY feature, horizon, trade_date, ret) - 1) / 2.0::DOUBLE AS rr FROM {source}),
{name} AS (SELECT feature, horizon, trade_date, covar_pop(rs, rr) / nullif(stddev_pop(rs) * stddev_pop(rr), 0) AS rank_ic, covar_pop(score, ret) / nullif(stddev_pop(score) * stddev_pop(ret), 0) AS ic FROM {name}_r GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


EVIDENCE_SQL = f"""{B}, {RETS}, spread AS (SELECT symbol, trade_date, amount, volume, ret AS last, unnest([{_H}]) AS l FROM rets), pairs AS (SELECT * FROM (SELECT trade_date, l.h AS horizon, l.r AS ret, unnest([{{'f': 'last', 's': last}}, {{'f': 'amount', 's': amount}}, {{'f': 'volume', 's': volume}}, {{'f': 'nothing', 's': NULL}}], recursive := true) FROM spread) AS t(trade_date, horizon, ret, feature, score)),
able AS (SELECT * FROM pairs WHERE score IS NOT NULL AND ret IS NOT NULL), usual AS (SELECT * FROM able QUALIFY cume_dist() OVER (PARTITION BY feature, horizon, trade_date ORDER BY ret DESC) > {S.TAIL}), {_ranked('daily', 'able')}, {_ranked('tails', 'usual')},
whole AS (SELECT feature, horizon, count(*) AS valid_dates, avg(rank_ic) AS rank_ic FROM daily WHERE ic IS NOT NULL GROUP BY 1, 2), parts AS (SELECT feature, horizon, date_trunc('week', trade_date) AS w, avg(rank_ic) AS part FROM daily WHERE ic IS NOT NULL GROUP BY 1, 2, 3), same AS (SELECT feature, horizon, count(*) FILTER (part * rank_ic > 0) AS aligned FROM parts JOIN whole USING (feature, horizon) GROUP BY 1, 2),
tail AS (SELECT feature, horizon, avg(rank_ic) AS tail_rank_ic FROM tails WHERE ic IS NOT NULL GROUP BY 1, 2), fifths AS (SELECT *, least(5, ceil(cume_dist() OVER (PARTITION BY feature, horizon, trade_date ORDER BY score) * 5)) AS q FROM (SELECT * FROM able QUALIFY count(*) OVER (PARTITION BY feature, horizon, trade_date) >= 5)),
means AS (SELECT feature, horizon, q, avg(m) AS m FROM (SELECT feature, horizon, trade_date, q, avg(ret) AS m FROM fifths GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), gaps AS (SELECT feature, horizon, max(m) FILTER (q = 5) - max(m) FILTER (q = 1) AS gap FROM means GROUP BY 1, 2),
evidence AS (SELECT feature, horizon, valid_dates, rank_ic, tail_rank_ic, gap, aligned FROM whole JOIN same USING (feature, horizon) LEFT JOIN tail USING (feature, horizon) LEFT JOIN gaps USING (feature, horizon))"""


def pairs(spark, sf) -> DataFrame:
    """Three scores and an empty one, with forward returns of four horizons."""
    x = rets(spark, sf).withColumns({f"f{h}": C.ratio(F.lead("close", h).over(T.SYMBOL), "close") - 1 for h in HORIZONS})
    scores = [F.struct(F.lit(n).alias("feature"), c.cast("double").alias("score")) for n, c in (("last", F.col("ret")), ("amount", F.col("amount")), ("volume", F.col("volume")), ("nothing", F.lit(None)))]
    ends = [F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("ret")) for h in HORIZONS]
    return x.select("trade_date", F.array(*scores).alias("s"), F.explode(F.array(*ends)).alias("l")).select("trade_date", "l.*", F.explode("s").alias("s")).select("trade_date", "horizon", "ret", "s.*")


def week():
    return F.date_trunc("week", "trade_date")


@query("DOM_19_horizon_evidence", f"""{EVIDENCE_SQL} SELECT feature, horizon, valid_dates, round(rank_ic, 6) AS rank_ic, round(tail_rank_ic, 6) AS tail_rank_ic, round(gap, 5) AS spread, aligned FROM evidence""")
def horizon_evidence(spark, sf):
    e = S.horizon_evidence(pairs(spark, sf), 5, week())
    return e.select("feature", "horizon", "valid_dates", F.round("rank_ic", 6).alias("rank_ic"), F.round("tail_rank_ic", 6).alias("tail_rank_ic"), F.round("spread", 5).alias("spread"), "aligned")


@query("DOM_19_feature_classes", f"""{EVIDENCE_SQL}, told AS (SELECT feature, count(*) AS usable, count(*) FILTER (valid_dates >= {DATES}) AS long, count(*) FILTER (abs(rank_ic) >= 0.005 AND rank_ic > 0) AS up, count(*) FILTER (abs(rank_ic) >= 0.005 AND rank_ic < 0) AS down, count(*) FILTER (abs(rank_ic) >= 0.01) AS strong,
  count(*) FILTER (abs(rank_ic) >= 0.01 AND gap * rank_ic > 0) AS agreed, coalesce(max(aligned) FILTER (abs(rank_ic) >= 0.01), 0) AS aligned, coalesce(list(('TAIL_5PCT_LOSS_H' || horizon) ORDER BY 'TAIL_5PCT_LOSS_H' || horizon) FILTER (rank_ic <> 0 AND (abs(tail_rank_ic) / abs(rank_ic) < 0.5 OR tail_rank_ic * rank_ic < 0)), []) AS lost FROM evidence GROUP BY 1),
named AS (SELECT *, CASE WHEN usable IS NULL OR usable < 3 OR long < 3 THEN 'INSUFFICIENT_SAMPLE' WHEN len(lost) > 0 THEN 'TAIL_DEPENDENT' WHEN up > 0 AND down > 0 THEN 'UNSTABLE' WHEN up + down = 0 THEN 'NO_SIGNAL' WHEN strong >= 3 AND agreed >= 3 AND aligned >= 2 THEN 'PROMISING' ELSE 'WEAK' END AS class FROM (SELECT DISTINCT feature FROM pairs) LEFT JOIN told USING (feature))
SELECT feature, class, CASE class WHEN 'INSUFFICIENT_SAMPLE' THEN 'FEWER_THAN_3_USABLE_HORIZONS' WHEN 'TAIL_DEPENDENT' THEN CASE WHEN up > 0 AND down > 0 THEN 'CROSS_HORIZON_DIRECTION_REVERSAL,' ELSE '' END || array_to_string(lost, ',') WHEN 'UNSTABLE' THEN 'CROSS_HORIZON_DIRECTION_REVERSAL' WHEN 'NO_SIGNAL' THEN 'ALL_HORIZONS_ABS_RANK_IC_LT_0_005'
WHEN 'PROMISING' THEN CASE WHEN down = 0 THEN 'POSITIVE_DIRECTION' ELSE 'NEGATIVE_DIRECTION' END || ',MULTI_HORIZON_CONSISTENT' ELSE 'EVIDENCE_BELOW_PROMISING_RULE' END AS flags FROM named""")
def feature_classes(spark, sf):
    rows = pairs(spark, sf)
    return S.classified(rows.select("feature"), S.horizon_evidence(rows, 5, week()), DATES).withColumn("flags", F.array_join("flags", ","))
