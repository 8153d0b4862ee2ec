"""Returns by slices of many dimensions, and the class of each feature by all its horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.operators import evaluate as E

#: Thresholds of the classes.
NO_SIGNAL, PROMISING, TAIL_LOSS, TAIL, HORIZONS, YEARS = 0.005, 0.01, 0.50, 0.05, 3, 2


def dimensions() -> dict[str, Column]:
    """Eleven dimensions of an observation as arrays of texts; a missing value is a slice of its own. With the horizon, which groups every slice, they are twelve."""
    text = lambda c, missing: F.array(F.coalesce(F.col(c).cast("string"), F.lit(missing)))
    one = lambda c: F.array(c)
    sure = F.col("composite_confidence")
    kinds = F.when(F.size("anomaly_types") > 0, F.col("anomaly_types")).otherwise(F.array(F.lit("NONE")))
    return {
        "board": text("board", "UNKNOWN"), "industry": text("industry", "UNKNOWN"), "factor_coverage": text("factor_coverage", "UNKNOWN"),
        "composite_confidence": one(F.when(sure.isNull(), "MISSING").when(sure < 0.4, "LOW").when(sure < 0.7, "MEDIUM").otherwise("HIGH")),
        "scanner_score_quantile": one(F.when(F.col("scanner_score").isNull(), "MISSING").otherwise(F.concat(F.lit("Q"), F.least(F.lit(4), (F.col("scanner_score") * 4).cast("int") + 1).cast("string")))),
        "anomaly_type": F.coalesce(kinds, F.array(F.lit("NONE"))), "freshness": one(F.when(F.coalesce("stale_snapshot", F.lit(False)), "STALE").otherwise("FRESH")), "veto_status": text("veto_status", "UNKNOWN"),
        "suspension": one(F.when(F.col("is_suspended").isNull(), "UNKNOWN").when(F.col("is_suspended"), "SUSPENDED").otherwise("TRADABLE")), "data_completeness": one(F.when(F.coalesce("data_complete", F.lit(False)), "COMPLETE").otherwise("PARTIAL")),
        "trade_date_range": one(F.date_format("trade_date", "yyyy-MM")),
    }


def sliced_returns(labelled: DataFrame, least: int) -> DataFrame:
    """(dimension, slice_value, horizon, sample_count, valid_count, conclusion, mean_return, median_return, win_rate) of every slice and horizon.

    labelled holds one row for each observation and horizon: the columns of ``dimensions``, horizon, ret, status, point_in_time. Only
    COMPLETE labels of rows valid in time count; without ``least`` of them there is no conclusion. A row that repeats a kind of anomaly
    counts in it as often. Medians are of returns rounded to six digits, so a hot slice keeps a count for each of these, not its rows.
    """
    valid = F.coalesce((F.col("status") == "COMPLETE") & F.col("point_in_time"), F.lit(False))
    named = lambda d: lambda v: F.struct(F.lit(d).alias("dimension"), v.alias("slice_value"))
    slices = [F.transform(values, named(d)) for d, values in (dimensions() | {"horizon": F.array(F.col("horizon").cast("string"))}).items()]
    rows = labelled.select("horizon", F.when(valid, F.round("ret", 6)).alias("ret"), F.explode(F.concat(*slices)).alias("s"))
    by = rows.groupBy("s.dimension", "s.slice_value", "horizon").agg(F.count("*").alias("sample_count"), F.count("ret").alias("valid_count"), F.avg("ret").alias("_mean"), F.percentile("ret", F.lit(0.5)).alias("_median"), F.avg((F.col("ret") > 0).cast("double")).alias("_win"))
    enough = F.col("valid_count") >= least
    return by.select("dimension", "slice_value", "horizon", "sample_count", "valid_count", enough.alias("conclusion"), *[F.when(enough, F.col(c)).alias(n) for c, n in (("_mean", "mean_return"), ("_median", "median_return"), ("_win", "win_rate"))])


def horizon_evidence(pairs: DataFrame, least: int, slice_of: Column) -> DataFrame:
    """(feature, horizon, valid_dates, rank_ic, tail_rank_ic, spread, aligned) of pairs(feature, horizon, trade_date, score, ret).

    The tail's rank correlation leaves out each day's best TAIL of returns; aligned counts the slices of time (``slice_of`` the date) whose mean has the whole's sign.
    """
    keys = ("feature", "horizon")
    daily = E.daily_ic(pairs, keys=keys, least=least).withColumn("_slice", slice_of)
    whole = daily.groupBy(*keys).agg(F.count("rank_ic").alias("valid_dates"), F.avg("rank_ic").alias("rank_ic"))
    parts = daily.groupBy(*keys, "_slice").agg(F.avg("rank_ic").alias("_part")).join(whole, [*keys]).groupBy(*keys).agg(F.first("valid_dates").alias("valid_dates"), F.first("rank_ic").alias("rank_ic"), F.count_if(F.col("_part") * F.col("rank_ic") > 0).alias("aligned"))
    day = Window.partitionBy(*keys, "trade_date").orderBy(F.desc("ret"))
    usual = pairs.where("score IS NOT NULL AND ret IS NOT NULL").withColumn("_tail", F.cume_dist().over(day)).where(F.col("_tail") > TAIL).drop("_tail")
    tail = E.daily_ic(usual, keys=keys, least=least).groupBy(*keys).agg(F.avg("rank_ic").alias("tail_rank_ic"))
    groups = E.quantile_returns(pairs, keys, least=least).groupBy(*keys).agg((F.max(F.when(F.col("quantile") == 5, F.col("ret"))) - F.max(F.when(F.col("quantile") == 1, F.col("ret")))).alias("spread"))
    return parts.join(tail, [*keys], "left").join(groups, [*keys], "left").select(*keys, "valid_dates", "rank_ic", "tail_rank_ic", "spread", "aligned")


def classified(features: DataFrame, evidence: DataFrame, dates: int = 60) -> DataFrame:
    """(feature, class, flags) of every row of features(feature): the first class of the ladder that fits, flags sorted.

    Three horizons of at least ``dates`` days are needed. A feature is TAIL_DEPENDENT if at some horizon its rank correlation turns, or
    falls below half, without each day's best returns; UNSTABLE if horizons disagree; NO_SIGNAL if all are weak; PROMISING if three
    strong horizons have spreads of their own sign, one of them in two slices of time; else WEAK.
    """
    ic, weak = F.col("rank_ic"), F.abs("rank_ic") < NO_SIGNAL
    strong = F.abs("rank_ic") >= PROMISING
    lost = (ic != 0) & ((F.abs("tail_rank_ic") / F.abs("rank_ic") < TAIL_LOSS) | (F.col("tail_rank_ic") * ic < 0))
    e = evidence.where(ic.isNotNull()).groupBy("feature").agg(
        F.count("*").alias("usable"), F.count_if(F.col("valid_dates") >= dates).alias("long"), F.count_if(~weak & (ic > 0)).alias("up"), F.count_if(~weak & (ic <= 0)).alias("down"), F.count_if(strong).alias("strong"),
        F.count_if(strong & (F.col("spread") * ic > 0)).alias("spread"), F.coalesce(F.max(F.when(strong, F.col("aligned"))), F.lit(0)).alias("aligned"), F.array_sort(F.collect_list(F.when(F.coalesce(lost, F.lit(False)), F.concat(F.lit("TAIL_5PCT_LOSS_H"), F.col("horizon").cast("string"))))).alias("tails"),
    )
    rows = features.select("feature").distinct().join(e, "feature", "left")
    short = F.col("usable").isNull() | (F.col("usable") < HORIZONS) | (F.col("long") < HORIZONS)
    turned = (F.col("up") > 0) & (F.col("down") > 0)
    good = (F.col("strong") >= HORIZONS) & (F.col("spread") >= HORIZONS) & (F.col("aligned") >= YEARS)
    named = F.when(short, "INSUFFICIENT_SAMPLE").when(F.size("tails") > 0, "TAIL_DEPENDENT").when(turned, "UNSTABLE").when(F.col("up") + F.col("down") == 0, "NO_SIGNAL").when(good, "PROMISING").otherwise("WEAK")
    reversal = F.array_compact(F.array(F.when(turned, "CROSS_HORIZON_DIRECTION_REVERSAL")))
    texts = {"INSUFFICIENT_SAMPLE": ["FEWER_THAN_3_USABLE_HORIZONS"], "NO_SIGNAL": ["ALL_HORIZONS_ABS_RANK_IC_LT_0_005"], "WEAK": ["EVIDENCE_BELOW_PROMISING_RULE"]}
    flags = F.when(F.col("class") == "TAIL_DEPENDENT", F.array_sort(F.concat(reversal, "tails"))).when(F.col("class") == "UNSTABLE", reversal)
    flags = flags.when(F.col("class") == "PROMISING", F.array(F.when(F.col("down") == 0, "POSITIVE_DIRECTION").otherwise("NEGATIVE_DIRECTION"), F.lit("MULTI_HORIZON_CONSISTENT")))
    for name, words in texts.items():
        flags = flags.when(F.col("class") == name, F.array(*[F.lit(w) for w in words]))
    return rows.withColumn("class", named).select("feature", "class", flags.alias("flags"))
