"""A query in SQL that calls the library's functions."""

from __future__ import annotations

from asoflab.functions import sql
from asoflab.plans.features import B
from asoflab.plans.registry import query
from asoflab.sources import views as V


@query("FN_sql_functions", f"""{B}, m AS (SELECT symbol, trade_date, close, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pc, rank() OVER (PARTITION BY trade_date ORDER BY amount) AS place, count(*) OVER (PARTITION BY trade_date, amount) AS ties, count(*) OVER (PARTITION BY trade_date) AS n FROM bars_b)
SELECT symbol, trade_date, round(close / nullif(pc, 0) - 1, 6) AS ret, round(greatest(-1, least(1, close / nullif(pc, 0) - 1)), 6) AS held, round(2.0 * (place - 1) / nullif(n - 1, 0) - 1, 6) AS signed, place + (ties - 1) / 2.0 AS average, coalesce(pc > 0 AND close >= pc * 1.1 * 0.999, false) AS up FROM m""".replace("greatest(-1, least(1, close / nullif(pc, 0) - 1))", "CASE WHEN close / nullif(pc, 0) IS NOT NULL THEN greatest(-1, least(1, close / nullif(pc, 0) - 1)) END"))
def sql_functions(spark, sf):
    sql.register(spark)
    return spark.sql(
        """WITH m AS (SELECT symbol, trade_date, close, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pc, rank() OVER (PARTITION BY trade_date ORDER BY amount) AS place,
          count(*) OVER (PARTITION BY trade_date, amount) AS ties, count(*) OVER (PARTITION BY trade_date) AS n FROM {bars})
        SELECT symbol, trade_date, round(safe_ratio(close, pc) - 1, 6) AS ret, round(clipped(safe_ratio(close, pc) - 1, -1, 1), 6) AS held, round(scaled_place(place, n, true), 6) AS signed,
          average_place(place, ties) AS average, at_limit(close, pc, 0.1, true) AS up FROM m""",
        bars=V.bars_b(spark, sf),
    )
