"""Streams with state against the batch forms: matured labels, clusters of reports in any order, restarts."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from asoflab.operators import news
from asoflab.sources import shared
from asoflab.streaming import clusters, matured
from asoflab.streaming import streams as S

DAY = dt.datetime(2024, 1, 1)


def parts(spark, df, folder, order):
    """Writes rows of df by their column ``file``, one file after the other."""
    for k in order:
        df.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(folder)


def prices(days, late=None):
    """(symbol, ts, close, high, low, file): a file for every five days; ``late`` bars come a file later."""
    r = random.Random(3)
    rows = []
    for s in (1, 2):
        for d in range(days):
            if (d + s) % 7:
                c = round(10 + r.random(), 3)
                rows.append((s, DAY + dt.timedelta(days=d), c, c + 0.3, c - 0.2, d // 5 + (1 if (s, d) in (late or ()) else 0)))
    return rows


BARS = "symbol long, ts timestamp, close double, high double, low double, file int"


def run(spark, events, checkpoint, out):
    q = matured.matured(events, "6 days", (1, 3, 5)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()


def rows(df):
    return sorted((x["symbol"], x["id"], x["horizon"], x["observed"], x["exit_ts"], round(x["ret"], 9), round(x["mae"], 9), round(x["mfe"], 9)) for x in df.collect())


def test_matured_labels_with_late_bars_and_a_restart(spark):
    bars = spark.createDataFrame(prices(40, late={(1, 9), (2, 13)}), BARS)
    seen = [(s, DAY + dt.timedelta(days=d, hours=1), 100 * s + d, 10.0 + d / 100, d // 5) for s in (1, 2, 3) for d in range(0, 38, 3)]
    observations = spark.createDataFrame(seen, "symbol long, ts timestamp, id long, close double, file int")
    a, b, checkpoint, out = (tempfile.mkdtemp(prefix="asoflab-") for _ in range(4))
    union = lambda: matured.union_stream(S.source(spark, a, observations.drop("file").schema), S.source(spark, b, bars.drop("file").schema))
    parts(spark, observations, a, range(4)), parts(spark, bars, b, range(4))
    run(spark, union(), checkpoint, out)
    first = spark.read.parquet(out).count()
    assert first > 0
    parts(spark, observations, a, range(4, 9)), parts(spark, bars, b, range(4, 9))
    run(spark, union(), checkpoint, out)  # goes on from the checkpoint
    got = rows(spark.read.parquet(out))
    passed = DAY + dt.timedelta(days=39) - dt.timedelta(days=6)
    want = rows(matured.matured_batch(observations, bars, (1, 3, 5), passed))
    assert len(got) > first and got == want and {x[0] for x in got} == {1, 2}


def test_matured_batch_by_hand(spark):
    bars = [(1, DAY + dt.timedelta(days=d), 10.0 + d, 12.0 + d, 9.0 - d, 0) for d in range(4)]
    observations = spark.createDataFrame([(1, DAY, 7, 10.0), (1, DAY + dt.timedelta(days=2, hours=5), 8, 20.0)], "symbol long, ts timestamp, id long, close double")
    got = rows(matured.matured_batch(observations, spark.createDataFrame(bars, BARS), (1, 3)))
    assert got == [(1, 7, 1, DAY, DAY + dt.timedelta(days=1), 0.1, -0.2, 0.3), (1, 7, 3, DAY, DAY + dt.timedelta(days=3), 0.3, -0.4, 0.5), (1, 8, 1, DAY + dt.timedelta(days=2, hours=5), DAY + dt.timedelta(days=3), -0.35, -0.7, -0.25)]


REPORT = "id long, type string, ts timestamp, title string, content_hash string, symbols array<string>"


def reports():
    r = random.Random(8)
    out = []
    for k in range(40):
        title = None if k == 5 else f"Title {k % 6}"
        out.append((k, "NEWS" if k % 9 else "NOTE", None if k == 7 else DAY + dt.timedelta(hours=r.randrange(0, 24 * 9)), title, r.choice(["h1", "h2", None, f"x{k}"]), r.choice([["a"], ["b"], ["a", "c"], [], None])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_any_order_of_arrival(spark, seed):
    shared.checkpoint_dir(spark)
    own = reports()
    want = sorted(tuple(x) for x in news.event_clusters(spark.createDataFrame(own, REPORT)).collect())
    assert 3 < len({c for _, c in want}) < 30
    r = random.Random(seed)
    r.shuffle(own)
    folder = tempfile.mkdtemp(prefix="asoflab-")
    batches = [own[:13], own[13:14], own[14:30], own[30:]]
    for k, b in enumerate(batches):
        df = spark.createDataFrame(b, REPORT)
        clusters.add_batch(df, k, folder)
        if k == 2:  # the batch is run again, as after an interruption
            clusters.add_batch(df, k, folder)
    got = sorted((x["id"], x["cluster"]) for x in clusters.current_labels(spark, folder).collect())
    assert got == want


def test_a_late_report_bridges_two_clusters(spark):
    shared.checkpoint_dir(spark)
    folder, source, checkpoint = (tempfile.mkdtemp(prefix="asoflab-") for _ in range(3))
    at = lambda i, h: (i, "NEWS", DAY + dt.timedelta(hours=h), "One title", f"h{i}", ["a"])
    told = lambda: {x["id"]: x["cluster"] for x in clusters.current_labels(spark, folder).collect()}
    for rows_ in ([at(4, 0), at(9, 40)], [at(7, 20)]):
        spark.createDataFrame(rows_, REPORT).coalesce(1).write.mode("append").parquet(source)
        clusters.clustered(S.source(spark, source, spark.createDataFrame([], REPORT).schema), folder, checkpoint).trigger(availableNow=True).start().awaitTermination()
        if len(rows_) == 2:
            assert told() == {4: 4, 9: 9}
    assert told() == {4: 4, 7: 4, 9: 4}
