"""The SQL of this package's newest queries gives their rows on the smallest tables."""

import duckdb
import pytest

from factloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_hard_negatives", "op13_spelling_variants"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect())
    assert got and got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
