"""A gate between two strategies on one set of cases: their outcomes case by case, paired, and the checks that follow.

Bounds of shares are Wilson's; bounds of paired differences are normal ones of the mean of the differences, so that what is
hard for both strategies doesn't widen them. The gate is closed unless every check passes: a failed redline or quality check
blocks, too little evidence says so. Everything is one aggregation over cases; the checks are rows of a short table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scores import share_or_zero, wilson

# Least numbers of cases, least and largest bounds of the new strategy, and how far it may fall behind.
POLICY = {
    "cases": 1_000, "answerable": 500, "abstention": 200, "safety": 300, "recall_low": 0.90, "top1_low": 0.85, "abstained_low": 0.95, "behind": 0.02, "leaks": 0, "leak_high": 0.01, "failure": 0.005, "failure_high": 0.01,
}
Z = 1.96


def outcomes(cases: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """cases (case_id, fact_id, role), with role `relevant`, `forbidden` or null for a case without facts, against results (case_id,
    fact_id, rank, failed) -> (case_id, relevant, guarded, and for this strategy recall, top1, abstained, leaked, failed)."""
    held = cases.groupBy("case_id").agg(F.count_if(F.col("role") == "relevant").alias("relevant"), (F.count_if(F.col("role") == "forbidden") > 0).alias("guarded"))
    met = results.join(cases.where("role is not null"), ["case_id", "fact_id"], "left")
    good = F.col("role") == "relevant"
    got = met.groupBy("case_id").agg(
        F.count_if(F.col("fact_id").isNotNull()).alias("n"), F.count_if(good).alias("hits"), F.bool_or(F.coalesce(good & (F.col("rank") == 1), F.lit(False))).alias("first"),
        F.bool_or(F.coalesce(F.col("role") == "forbidden", F.lit(False))).alias("leak"), F.bool_or("failed").alias("failed"),
    )
    rows = held.join(got, "case_id", "left")
    n, failed = F.coalesce("n", F.lit(0)), F.coalesce("failed", F.lit(False))
    value = {
        "recall": F.when(F.col("relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("relevant")), "top1": F.when(F.col("relevant") > 0, F.coalesce("first", F.lit(False)).cast("double")),
        "abstained": F.when(F.col("relevant") == 0, ((n == 0) & ~failed).cast("double")), "leaked": F.coalesce("leak", F.lit(False)).cast("double"), "failed": failed.cast("double"),
    }
    return rows.select("case_id", "relevant", "guarded", *(v.alias(f"{name}_{k}") for k, v in value.items()))


def report(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: numbers of cases, for each metric the means of both strategies, the new one's bounds, and the paired difference
    with its lower bound. old, new: outcomes named `a` and `b`."""
    rows = old.join(new.drop("relevant", "guarded"), "case_id")
    counts = [F.count("*").alias("cases"), F.count_if(F.col("relevant") > 0).alias("answerable"), F.count_if(F.col("relevant") == 0).alias("abstention"), F.count_if("guarded").alias("safety")]
    columns = list(counts)
    for m in ("recall", "top1", "abstained", "leaked", "failed"):
        a, b = F.col(f"a_{m}"), F.col(f"b_{m}")
        columns += [F.sum(b).alias(f"{m}_sum"), F.count(b).alias(f"{m}_n"), F.avg(a).alias(f"{m}_a"), F.avg(b).alias(f"{m}_b"), F.avg(b - a).alias(f"{m}_diff"), F.stddev_samp(b - a).alias(f"{m}_sd")]
    out = rows.agg(*columns)
    for m in ("recall", "top1", "abstained", "leaked", "failed"):
        bounds, n = wilson(F.coalesce(f"{m}_sum", F.lit(0.0)), F.col(f"{m}_n"), Z), F.col(f"{m}_n")
        behind = F.coalesce(f"{m}_diff", F.lit(0.0)) - Z * F.coalesce(f"{m}_sd", F.lit(0.0)) / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
        out = out.withColumns({f"{m}_low": bounds["low"], f"{m}_high": bounds["high"], f"{m}_behind": behind, f"{m}_rate": share_or_zero(F.coalesce(f"{m}_sum", F.lit(0.0)), n)})
    return out


def gate(report: DataFrame, trusted: Column, policy: dict = POLICY) -> DataFrame:
    """(check, kind, observed, required, passed, decision) for each check on a report; trusted: whether its cases may decide."""
    def least(check: str, kind: str, observed: str, required: float) -> Column:
        return _check(check, kind, F.col(observed), required, F.col(observed) >= required)

    def most(check: str, kind: str, observed: Column, required: float) -> Column:
        return _check(check, kind, observed, required, observed <= required)

    def _check(check: str, kind: str, observed: Column, required: float, passed: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(kind).alias("kind"), F.round(observed.cast("double"), 6).alias("observed"), F.lit(float(required)).alias("required"), F.coalesce(passed, F.lit(False)).alias("passed"))

    checks = [
        _check("trusted-purpose", "evidence", trusted.cast("int"), 1, trusted), *(least(f"minimum-{n}", "evidence", n, policy[n]) for n in ("cases", "answerable", "abstention", "safety")),
        most("forbidden-leaks", "redline", F.coalesce("leaked_sum", F.lit(0.0)), policy["leaks"]), most("failure-rate", "redline", F.col("failed_rate"), policy["failure"]),
        most("leak-upper95", "quality", F.col("leaked_high"), policy["leak_high"]), most("failure-upper95", "quality", F.col("failed_high"), policy["failure_high"]),
        *(least(f"{m}-lower95", "quality", f"{m}_low", policy[f"{m}_low"]) for m in ("recall", "top1", "abstained")),
        *(least(f"{m}-not-behind", "quality", f"{m}_diff", -policy["behind"]) for m in ("recall", "top1", "abstained")), *(least(f"{m}-not-behind-lower95", "quality", f"{m}_behind", -policy["behind"]) for m in ("recall", "top1", "abstained")),
    ]
    held = report.select(F.array(*checks).alias("checks"))
    fails = lambda kind: F.exists("checks", lambda c: (c["kind"] == kind) & ~c["passed"])
    decision = F.when(fails("redline"), "blocked").when(fails("evidence"), "insufficient-data").when(fails("quality"), "blocked").otherwise("eligible-for-review")
    return held.select(F.explode("checks").alias("c"), decision.alias("decision")).select("c.*", "decision")
