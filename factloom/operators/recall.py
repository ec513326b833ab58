"""Shards, tier budgets, bounded histories, review states and support of selected summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_shards(rows: DataFrame, owner: str, session: str) -> DataFrame:
    """rows once in the shard of their owner and, if they have a session, once in the shard of owner and session."""
    whole = F.concat(F.lit("o:"), F.col(owner).cast("string"))
    exact = F.when(F.col(session).isNotNull(), F.concat_ws("|", whole, F.concat(F.lit("s:"), F.col(session).cast("string"))))
    return rows.withColumn("shard", F.explode(F.array_compact(F.array(whole, exact))))


def tier_budgets(budget: Column, policy: Column) -> Column:
    """(hot, warm, cold, summaries) of a candidate budget: eager reads 25 % hot and 30 % cold; fallback a third hot, and cold
    up to 16 or a third, rounded up, for when the rest falls short; disabled reads none. Summaries: a quarter, 4 to 24."""
    third = F.lit(1.0) / 3
    hot = F.when(policy == "eager", F.floor(budget * 0.25)).otherwise(F.floor(budget * third))
    hot = F.greatest(F.lit(1), hot)
    cold = F.when(policy == "eager", F.floor(budget * 0.3)).otherwise(F.least(F.lit(16), F.ceil(budget * third)))
    cold = F.greatest(F.lit(1), cold)
    warm = F.greatest(F.lit(1), F.when(policy == "eager", budget - hot - cold).otherwise(budget - hot))

    def unless_disabled(c: Column, name: str) -> Column:
        return F.when(policy == "disabled", F.lit(0)).otherwise(c).cast("bigint").alias(name)

    summaries = F.greatest(F.lit(4), F.least(F.lit(24), F.floor(budget / 4))).cast("bigint").alias("summaries")
    return F.struct(unless_disabled(hot, "hot"), unless_disabled(warm, "warm"), unless_disabled(cold, "cold"), summaries)


def bounded_history(rows: DataFrame, by: str, most: int, *newest: Column) -> DataFrame:
    """The newest `most` rows of each group, and how many rows of the group overflow."""
    counts = rows.groupBy(by).agg(F.greatest(F.lit(0), F.count("*") - most).alias("overflow"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*newest))
    return rows.withColumn("place", place).where(F.col("place") <= most).join(counts, by)


def feedback_status(feedback: DataFrame) -> DataFrame:
    """feedback (outcome, fact_id, seen_at): per outcome its rows, those that name a fact or none, and the first and last time."""
    return feedback.groupBy("outcome").agg(
        F.count("*").alias("n"), F.count("fact_id").alias("named"), F.count_if(F.col("fact_id").isNull()).alias("missing"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at")
    )


def label_states(cases: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, state) of blind labels joined with their cases: labelled, missing (no label, or a null one), or extra."""
    named = cases.select(key).distinct().withColumn("known", F.lit(True))
    joined = named.join(labels.select(key, label).withColumn("given", F.lit(True)), key, "full")
    state = F.when(F.col("known").isNull(), "extra").when(F.col(label).isNull(), "missing").otherwise("labelled")
    return joined.select(key, label, state.alias("state"))


def reviews(feedback: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidates, confirmed): a review is confirmed if all its candidates have a verdict, adopted, corrected or denied,
    and none has both a good and a bad one."""
    verdict = F.col("outcome").isin("adopted", "corrected", "denied")
    facts = feedback.where("fact_id is not null").groupBy(*by, "fact_id").agg(F.max(verdict).alias("labelled"), F.max(F.col("outcome") == "adopted").alias("good"), F.max(F.col("outcome") == "denied").alias("bad"))
    rule = F.every("labelled") & ~F.some(F.col("good") & F.col("bad"))
    return facts.groupBy(*by).agg(F.sort_array(F.collect_list("fact_id")).alias("candidates"), rule.alias("confirmed"))


def purged_reviews(reviews: DataFrame, by: list[str], erased: DataFrame) -> DataFrame:
    """reviews without the candidates of erased (fact_id): reviews without any left go, those that lost one are unconfirmed."""
    each = reviews.select(*by, "confirmed", F.size("candidates").alias("before"), F.explode("candidates").alias("fact_id"))
    left = each.join(erased.select("fact_id").distinct(), "fact_id", "left_anti").groupBy(*by, "confirmed", "before").agg(F.sort_array(F.collect_list("fact_id")).alias("candidates"))
    return left.select(*by, "candidates", (F.col("confirmed") & (F.size("candidates") == F.col("before"))).alias("confirmed"))


def claim_key(scope: Column, predicate: Column, arguments: dict[str, Column]) -> Column:
    """Identity of a claim: scope, predicate and its arguments in the order of their roles, each with its length before it,
    so that no sign in a part can stand for a border; a null part is told from an empty one. Hashed."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    parts = [scope, predicate, *(x for role, value in sorted(arguments.items()) for x in (F.lit(role), value))]
    return F.sha2(F.concat(*map(part, parts)), 256)


def drilled_down(summaries: DataFrame, links: DataFrame) -> DataFrame:
    """summaries (summary_id, score) and links (summary_id, fact_id, strength): each fact that a summary supports, with its
    best support, score times strength, and the summary that gives it; ties go to the smaller summary."""
    support = (F.col("score") * F.col("strength")).alias("support")
    held = links.join(summaries, "summary_id").select("fact_id", "summary_id", support)
    best = held.groupBy("fact_id").agg(F.max(F.struct("support", (-F.col("summary_id")).alias("s"))).alias("b"), F.count("*").alias("summaries"))
    return best.select("fact_id", (-F.col("b.s")).alias("summary_id"), F.col("b.support").alias("support"), "summaries")
