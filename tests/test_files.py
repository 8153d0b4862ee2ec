"""Readers and writers of files."""

import tempfile

from asoflab.operators import pit
from asoflab.sources import files


def test_round_trips(spark):
    folder = tempfile.mkdtemp(prefix="asoflab-files-")
    df = files.from_rows(spark, [(2, "b", 1.5), (1, "a", None)], "k int, s string, v double", "t_rows")
    assert spark.sql("SELECT count(*) FROM t_rows").first()[0] == 2
    files.write_report(df, f"{folder}/csv", ["k"])
    assert files.read_csv(spark, f"{folder}/csv", "k int, s string, v double").orderBy("k").collect() == df.orderBy("k").collect()
    files.write_summary(df, f"{folder}/json")
    assert spark.read.schema("k int, s string, v double").json(f"{folder}/json").count() == 2
    with open(f"{folder}/rows.json", "w") as f:
        f.write('[{"k": 1, "s": "x"},\n {"k": 2}]')
    assert files.read_json(spark, f"{folder}/rows.json", "k int, s string").count() == 2
    files.replace_table(df, f"{folder}/p", ["k"])
    files.replace_table(df, f"{folder}/p", ["k"])
    assert spark.read.parquet(f"{folder}/p").count() == 2
    files.open_sources(spark, {"t_stored": f"{folder}/p"})
    assert spark.sql("SELECT sum(k) FROM t_stored").first()[0] == 3


def test_audit_rows_append_once(spark):
    items = files.audit_rows(files.from_rows(spark, [(1,), (2,)], "k int"), "plan", ["k"])
    assert pit.append_new(items, items, ["item_id"]).count() == 0
    assert items.select("item_id").distinct().count() == 2 and items.select("run_id").distinct().count() == 1
