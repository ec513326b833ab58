"""Hashed vectors in their rows, and recall by them."""

import math

from pyspark.sql import functions as F

from core_helpers import SF
from factloom.functions import hashing, text
from factloom.operators import hybrid as h
from factloom.plans import hybrid as plans

TEXTS = [None, "", "a", "日", "日 本 語 abcd", "Hello wörld İSTANBUL 100 abcdefgh", "\U0001f600abcd鲁迅 music music", "x" * 500 + " 今天"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summed(spark, df, tags=None):
    """The same vectors from one row for each occurrence of a term."""
    rows = df.select("id", F.explode(text.hashed_terms("t", 384, tags)).alias("d")).groupBy("id", "d.dim").agg(F.sum("d.sign").alias("w")).where("w <> 0").collect()
    norm = {i: math.sqrt(sum(r.w**2 for r in rows if r.id == i)) for i in {r.id for r in rows}}
    return {(r.id, r.dim): r.w / norm[r.id] for r in rows}


def test_vectors_equal_summed_terms(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").coalesce(1)
    for tags in (None, F.array(F.lit("a.b"), F.col("t"))):
        tags = tags if tags is None else F.array_compact(tags)
        got = {(r.id, r.dim): r.weight for r in df.select("id", F.inline(hashing.hashed_vector("t", 384, tags))).collect()}
        assert got == summed(spark, df, tags)
    whole = {r.id: r.v for r in df.select("id", hashing.hashed_vector("t", 384, whole=True).alias("v")).collect()}
    assert {(i, d): w for i, v in whole.items() for d, w in enumerate(v) if w} == summed(spark, df) and {len(v) for v in whole.values()} == {384}
    monkeypatch.setattr(hashing, "TEXTS", 3)
    assert list(hashing._parts(["ab"] * 7)) == [(0, 3), (3, 6), (6, 7)] and list(hashing._parts([])) == []


def test_embeddings_make_no_row_for_a_dimension(spark):
    of = plan(plans.hashed_embeddings(spark, SF))
    assert "explode(dims" not in of and "dim#" not in of.replace("first_dim#", "")


def test_similar_texts_meet_once(spark):
    both = [(7, 1, [(0, 0.6), (2, 0.8)], [(0, 1.0)]), (7, 2, [(0, 0.6), (2, 0.8)], [(1, 1.0)]), (7, 3, [(0, 0.6), (2, 0.8)], [(0, -0.8), (2, 0.6)]), (7, 4, [], [(0, 1.0)]), (7, 5, [(0, 1.0)], [])]
    met = spark.createDataFrame(both, f"request_id long, id long, asked {hashing.VECTOR}, dims {hashing.VECTOR}")
    assert {(r.id, r.semantic) for r in h.similar(met).collect()} == {(1, 0.6), (3, 0.0)}


def test_questions_of_one_file_are_planned_on_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("id AS request_id", "id AS owner", "'Which city do I live in?' AS text").coalesce(1).write.parquet(f"{tmp_path}/q")
    assert len(h.planned(spark.read.parquet(f"{tmp_path}/q")).inputFiles()) == spark.sparkContext.defaultParallelism


def test_a_ranking_goes_on_from_batch_to_batch(spark):
    asked = h.planned(spark.createDataFrame([(i, i, "recap everything about me") for i in range(3)], "request_id long, owner long, text string"))
    words = "alpha bravo charlie delta echo foxtrot golf".split()
    ranked = spark.createDataFrame([(r, 10 * r + i, i + 1, 0.9 - i / 100, f"{w} {w}{r}") for r in range(2) for i, w in enumerate(words)], "request_id long, id long, rank int, score double, content string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(h.adaptive(asked, ranked))
    assert [r for r in want if r[0] == 2] == [(2, 0, None, None, 0, 0, "abstain-low-confidence")] and sum(r[0] == 0 for r in want) > 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        df = h.adaptive(asked, ranked)
        assert rows(df) == want and "FlatMapGroupsInPandas" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
