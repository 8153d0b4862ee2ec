"""Every registered query against its SQL text on the smallest tables."""

import math

import pytest
from conftest import SF

from asoflab.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    assert got, "no rows"
    sql = registry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = [tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()]
        a, b = rows_of(got), rows_of(want)
        assert len(a) == len(b)
        assert a == b
