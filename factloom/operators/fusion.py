"""Rank fusion and quality scores over candidate routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(routes: DataFrame, constant: float = 60.0, window: int = 100) -> DataFrame:
    """routes (query_id, id, route, rank) -> (query_id, id, fused, relative, routes): sum of 1 / (constant + rank) over
    the routes, each at its first occurrence within the window; relative to the query's best."""
    first = routes.where(F.col("rank") <= window).groupBy("query_id", "id", "route").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("query_id", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("fused"), F.count("*").alias("routes"))
    return fused.withColumn("relative", F.col("fused") / F.max("fused").over(Window.partitionBy("query_id")))


def fused_quality(relative: Column, routes: Column, of_routes: int, importance: Column, confidence: Column, temporal: Column, recency: Column) -> Column:
    agreement = routes / F.lit(float(of_routes))
    return F.round(0.78 * relative + 0.09 * agreement + 0.06 * (0.45 * importance + 0.55 * confidence) + 0.05 * temporal + 0.02 * recency, 2)


def weighted_linear(semantic: Column, lexical: Column, importance: Column, recency: Column, frequency: Column, temporal: Column) -> Column:
    return 0.40 * semantic + 0.20 * lexical + 0.14 * importance + 0.08 * recency + 0.04 * frequency + 0.14 * temporal


def tier_quota(scored: DataFrame, quotas: dict[str, int], total: int) -> DataFrame:
    """Of each query the best of each tier up to its quota, merged by score and cut to the total."""
    quota = F.coalesce(*(F.when(F.col("tier") == t, F.lit(n)) for t, n in quotas.items()), F.lit(0))
    own = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "id"))
    kept = scored.withColumn("_own", own).where(F.col("_own") <= quota).drop("_own")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= total)


def within_budget(ranked: DataFrame, by: str, cost: Column, budget: int) -> DataFrame:
    """Rows in rank order while their running cost stays within the budget."""
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("spent", spent).where(F.col("spent") <= budget)
