"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "entry_breadth_regime", "AGG_2_breadth", "AGG_21_sectors", "DOM_5_replay_base", "DOM_7_labels_statistical", "DOM_7_labels_executable", "DOM_11_daily_ic",
    "DOM_12_20_ic_summary", "DOM_13_quantile_returns", "DOM_25_composite", "DOM_27_cross_section", "DOM_3_scan", "DOM_40_positions", "TS_1_moving_averages",
    "TS_3_macd", "TS_22_patterns", "JOIN_3_intervals", "JOIN_5_asof", "JOIN_7_dense_grid", "WIN_3_scaled_rank", "AGG_31_corr_matrix", "DOM_31_canonical_records",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from asoflab.plans import registry

    queries = registry.queries()
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # the session and the readers are warm
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
