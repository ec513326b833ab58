"""Every registered query with SQL gives its rows on the smallest tables; names and columns agree."""

import math

import duckdb
import pytest

from core_helpers import SF
from factloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (int, bool)):
        return repr(round(float(v), 9))
    return "null" if v is None else str(list(map(plain, v))) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["query_id", "shard", "id", "rank", "score", "squashed"] and df.count() > 0
