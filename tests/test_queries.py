"""Every registered cohort query against its own SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from cohortry import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in plans.ORACLE:
        assert got
        return
    want = duck.sql(plans.ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall()))
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got) == rows


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
