"""Functions of the library that spark.sql can call: temporary SQL functions, so Catalyst inlines them like any expression.

Each states what the Column function of the same task does; tests hold the two against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Full-width characters and the ASCII ones that they stand for, as SQL text.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("\\", "\\\\").replace("'", "\\'")

#: name -> (arguments, result, body)
FUNCTIONS = {
    "safe_ratio": ("x DOUBLE, y DOUBLE", "DOUBLE", "try_divide(x, nullif(y, 0.0D))"),
    "clipped": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(low, least(high, x)) END"),
    "scaled_place": ("place BIGINT, n BIGINT, signed BOOLEAN", "DOUBLE", "CASE WHEN signed THEN 2.0D ELSE 1.0D END * try_divide(CAST(place - 1 AS DOUBLE), nullif(n - 1, 0)) - CASE WHEN signed THEN 1.0D ELSE 0.0D END"),
    "average_place": ("place BIGINT, ties BIGINT", "DOUBLE", "place + (ties - 1) / 2.0D"),
    "plain_title": ("t STRING", "STRING", f"regexp_replace(lower(translate(t, '{_WIDE}', '{_NARROW}')), r'[^\\p{{L}}\\p{{N}}_]', '')"),
    "freshness": ("age DOUBLE", "STRING", "CASE WHEN age <= 145 THEN 'FRESH' WHEN age <= 290 THEN 'DEGRADED' ELSE 'STALE' END"),
    "at_limit": ("price DOUBLE, previous DOUBLE, rate DOUBLE, up BOOLEAN", "BOOLEAN", "coalesce(previous > 0 AND CASE WHEN up THEN price >= previous * (1 + rate) * 0.999D ELSE price <= previous * (1 - rate) * 1.001D END, false)"),
}


def register(spark: SparkSession) -> None:
    """Creates the functions in the session; a second call replaces them."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
