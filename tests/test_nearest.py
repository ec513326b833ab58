"""Nearest documents by hashed vectors."""

import math

from pyspark.sql import functions as F

from core_helpers import SF
from factloom.functions import text
from factloom.operators import vectors
from factloom.plans import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summed(spark, df, tags=None):
    """The same vectors from one row for each occurrence of a term."""
    rows = df.select("id", F.explode(text.hashed_terms("t", 384, tags)).alias("d")).groupBy("id", "d.dim").agg(F.sum("d.sign").alias("w")).where("w <> 0").collect()
    norm = {i: math.sqrt(sum(r.w**2 for r in rows if r.id == i)) for i in {r.id for r in rows}}
    return {(r.id, r.dim): r.w / norm[r.id] for r in rows}


def test_nearest_documents_meet_in_tiles(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "beta gamma", "", None, "日本", "alpha beta"])], "id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "")], "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in vectors.nearest(queries, docs, "text", 5).collect()}
    of = {k: summed(spark, d.withColumnRenamed("text", "t").withColumnRenamed("query_id", "id")) for k, d in (("q", queries), ("d", docs))}
    dims = lambda side, i: {d: w for (k, d), w in of[side].items() if k == i}
    q = dims("q", 1)
    want = {(1, i): sum(q[d] * w for d, w in dims("d", i).items() if d in q) for i in range(6) if q.keys() & dims("d", i).keys()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
    assert "hashpartitioning(dim" not in plan(jobs.hashed_neighbours(spark, SF))
