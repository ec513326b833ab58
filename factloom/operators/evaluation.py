"""Retrieval, extraction and strategy metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scores import share_or_zero


def case_metrics(hits: DataFrame, relevant: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """hits (case_id, id, rank), relevant (case_id, id), cases (case_id, ...) -> per case: hits, recall, first hit,
    top-1, reciprocal rank, binary nDCG, and whether an unanswerable case was left empty."""
    wanted = relevant.groupBy("case_id").agg(F.count("*").alias("n_relevant"))
    got = hits.where(F.col("rank") <= k)
    found = got.join(relevant, ["case_id", "id"]).groupBy("case_id").agg(
        F.count("*").alias("n_hits"), F.min("rank").alias("first_rank"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    any_hit = got.groupBy("case_id").agg(F.count("*").alias("n_returned"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = cases.join(wanted, "case_id", "left").join(found, "case_id", "left").join(any_hit, "case_id", "left")
    rows = rows.na.fill(0, ["n_relevant", "n_hits", "n_returned"])
    answerable = F.col("n_relevant") > 0
    return rows.withColumns(
        {
            "answerable": answerable,
            "recall": F.when(answerable, F.col("n_hits") / F.col("n_relevant")),
            "hit": F.when(answerable, (F.col("n_hits") > 0).cast("double")),
            "top1": F.when(answerable, F.coalesce((F.col("first_rank") == 1).cast("double"), F.lit(0.0))),
            "mrr": F.when(answerable, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))),
            "ndcg": F.when(answerable, F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal),
            "abstained": F.when(~answerable, (F.col("n_returned") == 0).cast("double")),
        }
    )


METRICS = ("recall", "hit", "top1", "mrr", "ndcg", "abstained")


def rolled_up(cases: DataFrame, by: str) -> DataFrame:
    """Mean metrics of each category and, with a null category, of all cases."""
    return cases.rollup(by).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS))


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(case_id, id) rows of two strategies -> per case: sizes, common, Jaccard, recall and precision of b against a."""
    left, right = a.select("case_id", "id").distinct().withColumn("in_a", F.lit(1)), b.select("case_id", "id").distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, ["case_id", "id"], "full").na.fill(0, ["in_a", "in_b"])
    g = both.groupBy("case_id").agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("common"))
    c = F.col("common")
    return g.withColumns(
        {"jaccard": share_or_zero(c, F.col("n_a") + F.col("n_b") - c), "recall": share_or_zero(c, F.col("n_a")), "precision": share_or_zero(c, F.col("n_b"))}
    )


def extraction_prf(gold: DataFrame, predicted: DataFrame, by: str) -> DataFrame:
    """Distinct rows of both (same columns): TP, FP, FN and P, R, F1 of each group and, with a null group, of all."""
    keys = gold.columns
    rows = gold.distinct().withColumn("g", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), keys, "full").na.fill(0, ["g", "p"])
    c = rows.rollup(by).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    p, r = share_or_zero(F.col("tp"), F.col("tp") + F.col("fp")), share_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r, "f1": share_or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
