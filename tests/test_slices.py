"""Slices of returns and classes of features on rows whose answers are known."""

import datetime as dt

from pyspark.sql import functions as F

from asoflab.operators import slices as S

DAY = dt.date(2024, 3, 1)
FIELDS = "board string, industry string, factor_coverage string, composite_confidence double, scanner_score double, anomaly_types array<string>, stale_snapshot boolean, veto_status string, is_suspended boolean, data_complete boolean, trade_date date, horizon int, ret double, status string, point_in_time boolean"


def test_slices_of_each_dimension(spark):
    rows = [
        ("MAIN", None, "FULL", 0.7, 1.0, ["A", "B"], False, "CLEAR", False, True, DAY, 5, 0.10, "COMPLETE", True), ("MAIN", None, "FULL", 0.4, 0.0, [], True, "CLEAR", None, False, DAY, 5, -0.02, "COMPLETE", True),
        ("MAIN", "X", "FULL", None, None, None, None, None, True, None, DAY, 5, 0.5, "PENDING", True), ("MAIN", "X", "FULL", 0.1, 0.5, ["A"], None, None, True, None, DAY, 5, 0.5, "COMPLETE", False),
    ]
    got = {(r["dimension"], r["slice_value"]): r for r in S.sliced_returns(spark.createDataFrame(rows, FIELDS), 2).collect()}
    main = got["board", "MAIN"]
    assert (main["sample_count"], main["valid_count"], main["conclusion"], main["median_return"], main["win_rate"]) == (4, 2, True, 0.04, 0.5) and abs(main["mean_return"] - 0.04) < 1e-12
    assert got["industry", "UNKNOWN"]["sample_count"] == 2 and got["industry", "X"]["conclusion"] is False and got["industry", "X"]["mean_return"] is None
    assert {v for d, v in got if d == "composite_confidence"} == {"HIGH", "MEDIUM", "MISSING", "LOW"} and {v for d, v in got if d == "scanner_score_quantile"} == {"Q4", "Q1", "MISSING", "Q3"}
    assert {v: r["sample_count"] for (d, v), r in got.items() if d == "anomaly_type"} == {"A": 2, "B": 1, "NONE": 2}
    assert {v: r["sample_count"] for (d, v), r in got.items() if d == "suspension"} == {"TRADABLE": 1, "UNKNOWN": 1, "SUSPENDED": 2}
    assert len({d for d, _ in got}) == 12 and ("trade_date_range", "2024-03") in got
    assert S.sliced_returns(spark.createDataFrame([], FIELDS), 2).count() == 0


def test_classes_in_order_of_the_ladder(spark):
    def rows(name, ics, tails=None, spreads=None, aligned=3, dates=60):
        return [(name, h, dates, ic, (tails or ics)[h], (spreads or ics)[h], aligned) for h, ic in enumerate(ics)]

    found = [
        *rows("few", [0.1, 0.1]), *rows("brief", [0.1] * 4, dates=59), *rows("tail", [0.1] * 3, [0.1, 0.04, 0.1]), *rows("both", [0.1, -0.1, 0.1], [0.1, 0.1, 0.1]), *rows("turned", [0.1, -0.1, 0.1]), *rows("none", [0.004, -0.004, 0.0]),
        *rows("good", [0.02] * 3), *rows("bad", [-0.02] * 3), *rows("flat", [0.02] * 3, spreads=[-0.1] * 3), *rows("unsteady", [0.02] * 3, aligned=1), *rows("weak", [0.006] * 3), *rows("void", [None] * 3),
    ]
    evidence = spark.createDataFrame(found, "feature string, horizon int, valid_dates long, rank_ic double, tail_rank_ic double, spread double, aligned long")
    names = spark.createDataFrame([(r[0],) for r in found] + [("absent",)], "feature string")
    got = {r["feature"]: (r["class"], r["flags"]) for r in S.classified(names, evidence).collect()}
    short, below = ("INSUFFICIENT_SAMPLE", ["FEWER_THAN_3_USABLE_HORIZONS"]), ("WEAK", ["EVIDENCE_BELOW_PROMISING_RULE"])
    assert got == {
        "few": short, "brief": short, "void": short, "absent": short, "tail": ("TAIL_DEPENDENT", ["TAIL_5PCT_LOSS_H1"]), "both": ("TAIL_DEPENDENT", ["CROSS_HORIZON_DIRECTION_REVERSAL", "TAIL_5PCT_LOSS_H1"]), "turned": ("UNSTABLE", ["CROSS_HORIZON_DIRECTION_REVERSAL"]),
        "none": ("NO_SIGNAL", ["ALL_HORIZONS_ABS_RANK_IC_LT_0_005"]), "good": ("PROMISING", ["POSITIVE_DIRECTION", "MULTI_HORIZON_CONSISTENT"]), "bad": ("PROMISING", ["NEGATIVE_DIRECTION", "MULTI_HORIZON_CONSISTENT"]), "flat": below, "unsteady": below, "weak": below,
    }


def test_evidence_of_a_score_that_lives_on_one_winner(spark):
    """Twenty rows a day: without the day's best return nothing is left of the correlation."""
    rows = [("s", 1, dt.date(2024, 1, d), float(k == 19), 5.0 if k == 19 else ((k * 7) % 19) / 100) for d in range(1, 9) for k in range(20)]
    pairs = spark.createDataFrame(rows, "feature string, horizon int, trade_date date, score double, ret double")
    (e,) = S.horizon_evidence(pairs, 5, F.month("trade_date")).collect()
    assert e["valid_dates"] == 8 and e["rank_ic"] > 0.3 and e["tail_rank_ic"] is None and e["aligned"] == 1
