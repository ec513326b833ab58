"""Thresholds, confusion metrics and calibration tables over scored samples (score, relevant)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scores import share_or_zero


def fitted_thresholds(samples: DataFrame, by: list[str], false_positive_cost: float = 2.0, false_negative_cost: float = 1.0) -> DataFrame:
    """The threshold of least cost for each group: rows at or above it are accepted. Ties go to the higher balanced
    accuracy, then to the larger threshold. Scores are counted once each before the running sums."""
    counted = samples.groupBy(*by, "score").agg(F.count_if("relevant").alias("pos"), F.count_if(~F.col("relevant")).alias("neg"))
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "p": F.sum("pos").over(group), "n": F.sum("neg").over(group)})
    cost = false_positive_cost * F.col("fp") + false_negative_cost * (F.col("p") - F.col("tp"))
    balanced = (share_or_zero(F.col("tp"), F.col("p")) + share_or_zero(F.col("n") - F.col("fp"), F.col("n"))) / 2
    best = run.withColumns({"cost": cost, "balanced": balanced}).groupBy(*by).agg(
        F.min(F.struct("cost", (-F.col("balanced")).alias("nb"), (-F.col("score")).alias("ns"))).alias("b"), F.first("p").alias("positives"), F.first("n").alias("negatives")
    )
    return best.select(*by, (-F.col("b.ns")).alias("threshold"), F.col("b.cost").alias("cost"), (-F.col("b.nb")).alias("balanced_accuracy"), "positives", "negatives")


def confusion(samples: DataFrame, by: list[str]) -> DataFrame:
    """samples (accepted, relevant): counts and rates of each group; an empty denominator gives 0."""
    a, r = F.col("accepted"), F.col("relevant")
    c = samples.groupBy(*by).agg(
        F.count_if(a & r).alias("tp"), F.count_if(a & ~r).alias("fp"), F.count_if(~a & r).alias("fn"), F.count_if(~a & ~r).alias("tn"), F.count("*").alias("n")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recall, spec = share_or_zero(tp, tp + fn), share_or_zero(tn, tn + fp)
    return c.withColumns(
        {
            "precision": share_or_zero(tp, tp + fp), "recall": recall, "specificity": spec, "fpr": share_or_zero(fp, fp + tn),
            "accuracy": share_or_zero(tp + tn, F.col("n")), "balanced_accuracy": (recall + spec) / 2, "coverage": share_or_zero(tp + fp, F.col("n")),
        }
    )


def calibration_bins(samples: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins of a predicted probability: rows, mean prediction, share correct, gap."""
    index = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    grouped = samples.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg(F.col("relevant").cast("double")).alias("observed"))
    return grouped.withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def calibration_errors(samples: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected and largest calibration error, Brier score and log loss of each group."""
    y, p = F.col("relevant").cast("double"), F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = samples.groupBy(*by).agg(F.avg(F.pow(F.col("score") - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    table = calibration_bins(samples, by, bins).groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("max_error"))
    return table.join(loss, by)


def margin_thresholds(samples: DataFrame, by: list[str], false_positive_cost: float = 3.0) -> DataFrame:
    """The middle of the gap between the highest negative and the lowest positive score, where there is one, else the fitted
    threshold; (by, threshold, clean)."""
    positive, negative = F.min(F.when(F.col("relevant"), F.col("score"))), F.max(F.when(~F.col("relevant"), F.col("score")))
    ends = samples.groupBy(*by).agg(positive.alias("low"), negative.alias("high"))
    clean = F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    joined = fitted_thresholds(samples, by, false_positive_cost).join(ends, by)
    return joined.select(*by, F.when(clean, (F.col("low") + F.col("high")) / 2).otherwise(F.col("threshold")).alias("threshold"), clean.alias("clean"))
