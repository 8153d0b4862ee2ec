"""Domain tables derived from the driver's generic tables, and the same derivations as SQL.

bars_a   long histories with gaps (gaps act as suspensions): line items by supplier and ship date
bars_b   dense cross-sections: events by user and date
bars_c   long and dense, with moves of a few percent: line items of eight neighbouring suppliers by ship date, prices on a log scale
Every Spark derivation here has a common table expression of the same name in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "bars_a": """bars_a AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, arg_min(p, k) AS open, arg_max(p, k) AS close, max(p) AS high, min(p) AS low,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS p, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS k FROM lineitem) GROUP BY ALL)""",
    "bars_b": """bars_b AS (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close, max(value) AS high,
         min(value) AS low, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 2) AS amount FROM events GROUP BY ALL)""",
    "bars_c": """bars_c AS (
  SELECT l_suppkey // 8 AS symbol, CAST(l_shipdate AS DATE) AS trade_date, arg_min(p, k) AS open, arg_max(p, k) AS close, max(p) AS high, min(p) AS low,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, round(100 + 4 * (ln(l_extendedprice / l_quantity) - 7.5), 2) AS p, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS k FROM lineitem) GROUP BY ALL)""",
    "days_a": "days_a AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS trade_index FROM (SELECT DISTINCT trade_date FROM bars_a))",
    "days_b": "days_b AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS trade_index FROM (SELECT DISTINCT trade_date FROM bars_b))",
    "days_c": "days_c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS trade_index FROM (SELECT DISTINCT trade_date FROM bars_c))",
    "statuses": """statuses AS (
  SELECT o_custkey AS symbol, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS valid_from,
         CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_to, o_orderkey AS status_id FROM orders)""",
    "industries": """industries AS (SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "statements": """statements AS (
  SELECT o_custkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS revenue,
         round(sum(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN -0.05 ELSE 0.02 END), 2) AS profit,
         round(sum(o_totalprice) * 3, 2) AS assets, CAST(max(o_orderdate) AS DATE) + 30 AS available FROM orders GROUP BY 1, 2)""",
    "trades": """trades AS (
  SELECT l_suppkey AS portfolio, l_partkey % 10 AS symbol, CASE l_returnflag WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity,
         l_extendedprice / l_quantity AS price, l_extendedprice * l_tax AS fee, CAST(l_shipdate AS DATE) AS traded_on,
         (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS trade_id FROM lineitem)""",
}


def ctes(*names: str) -> str:
    """WITH clause of the named derivations, in the order of SQL."""
    return "WITH " + ", ".join(text for name, text in SQL.items() if name in names)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame) -> DataFrame:
    """rows(symbol, trade_date, p, k, volume, amount) as daily bars; one shuffle, combined before it."""
    return rows.groupBy("symbol", "trade_date").agg(F.min_by("p", "k").alias("open"), F.max_by("p", "k").alias("close"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("volume").alias("volume"), F.round(F.sum("amount"), 2).alias("amount"))


def bars_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")
    return _bars(rows.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), key.alias("k"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount")))


def bars_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return _bars(rows.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"), F.col("value").alias("p"), F.col("event_id").alias("k"), F.lit(1.0).alias("volume"), F.col("value").alias("amount")))


def dates_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of bars_a (and bars_c), from their column alone: no bars are built for a calendar."""
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))


def bars_c(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """together: line items move once, by symbol, so a symbol's bars are in one partition."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")
    price = F.round(100 + 4 * (F.log(F.col("amount") / F.col("volume")) - 7.5), 2)
    rows = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_suppkey") / 8).alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), key.alias("k"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"))
    rows = rows.repartition("symbol") if together else rows
    return _bars(rows.select("symbol", "trade_date", price.alias("p"), "k", "volume", "amount"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("symbol"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("valid_from"), F.to_date(F.lead("o_orderdate").over(by)).alias("valid_to"), F.col("o_orderkey").alias("status_id"))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (read(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = F.when(F.col("o_orderstatus") == "F", 0.1).when(F.col("o_orderstatus") == "O", -0.05).otherwise(0.02)
    by = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"))
    return by.agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.sum(F.col("o_totalprice") * margin), 2).alias("profit"), F.round(F.sum("o_totalprice") * 3, 2).alias("assets"), F.date_add(F.to_date(F.max("o_orderdate")), 30).alias("available"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("portfolio"), (F.col("l_partkey") % 10).alias("symbol"), side.alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"), F.to_date("l_shipdate").alias("traded_on"), key.alias("trade_id"))
