"""Every registered query against the same in SQL, on the smallest tables."""

import math

import pytest
from conftest import SF

from tidemark.queries import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    left = sorted((tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert left == right


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
