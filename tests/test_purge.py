"""Closures over edges that are costly to make."""

from pyspark.sql import functions as F

from factloom.operators import graph


def test_edges_of_a_purge_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long").select(F.udf(one, "long")("src").alias("src"), "dst")
    closed = graph.purge_closure(edges, spark.createDataFrame([(0,)], "node long"))
    assert {(r.node, r.round) for r in closed.collect()} == {(i, i) for i in range(7)} and seen.value == 6
