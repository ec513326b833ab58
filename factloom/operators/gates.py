"""Alias decisions, facts that share messages, exact source spans, and the metrics that gate writes and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import literals, scores


def canonical_members(decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """(member, canonical) after all accepted merges and splits of known entities, in recorded order.

    decisions (member, canonical, action, status, recorded_at, decision_id): the last one of a member holds, so that one
    aggregation replaces the fold."""
    known = entities.select("entity_id").distinct()
    held = decisions.where("status = 'accepted'")
    for side in ("canonical", "member"):
        held = held.join(known.withColumnRenamed("entity_id", side), side, "left_semi")
    last = held.groupBy("member").agg(F.max(F.struct("recorded_at", "decision_id", "canonical", "action")).alias("last"))
    return last.where("last.action <> 'split'").select("member", F.col("last.canonical").alias("canonical"))


def sharing_messages(seeds: DataFrame, links: DataFrame, most: int, seeds_of_query: int) -> DataFrame:
    """(query_id, fact_id, rank): per query the first `most` facts by id that share a message with one of its seeds.

    seeds (query_id, fact_id), links (episode_id, fact_id). A message offers its first most + seeds_of_query facts only: those
    that follow can't be among the first of a query, which drops at most its seeds. A hot message so costs its seeds that many
    rows each, not all its facts."""
    first = F.row_number().over(Window.partitionBy("episode_id").orderBy("fact_id"))
    distinct = links.select("episode_id", "fact_id").distinct()
    offered = distinct.withColumn("place", first).where(F.col("place") <= most + seeds_of_query).select("episode_id", "fact_id")
    asked = seeds.join(distinct, "fact_id").select("query_id", "episode_id").distinct()
    near = asked.join(offered, "episode_id").select("query_id", "fact_id").distinct().join(seeds, ["query_id", "fact_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("fact_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most)


def exact_spans(refs: DataFrame, episodes: DataFrame, shares: list[str], sensitivities: list[str]) -> DataFrame:
    """refs (ref_id, episode_id, content_hash, start, end in UTF-16 units) with the text they name, or the reason why there is
    none: missing, changed, withheld or span. episodes (episode_id, content, content_hash, share, sensitivity)."""
    held = episodes.select("episode_id", "content", "share", "sensitivity", F.col("content_hash").alias("held_hash"))
    rows = refs.join(held, "episode_id", "left").withColumn("span", literals.utf16_slice("content", F.col("start"), F.col("end")))
    allowed = F.col("share").isin(shares) & F.col("sensitivity").isin(sensitivities)
    reason = F.when(F.coalesce("content", F.lit("")) == "", "missing").when(~F.col("held_hash").eqNullSafe(F.col("content_hash")), "changed")
    reason = reason.when(~F.coalesce(allowed, F.lit(False)), "withheld").when(F.col("span").isNull(), "span")
    return rows.withColumn("reason", reason).select("ref_id", "episode_id", F.when(F.col("reason").isNull(), F.col("span")).alias("span"), "reason")


def matched_writes(expected: DataFrame, actual: DataFrame, *order: str) -> DataFrame:
    """Expected and actual writes (case_id, key, outcome, action, columns of order), the n-th of a key with the n-th, as
    (case_id, key, n, wanted, got, wanted_action, got_action); wanted or got is null where the other side has no such write."""

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("case_id", "key").orderBy(*order, "outcome", "action"))
        return rows.select("case_id", "key", n.alias("n"), F.col("outcome").alias(name), F.col("action").alias(f"{name}_action"))

    return numbered(expected, "wanted").join(numbered(actual, "got"), ["case_id", "key", "n"], "full")


def write_metrics(matched: DataFrame, *by: str) -> DataFrame:
    """Hits, misses, false alarms, and the rates of matched_writes in each group."""
    both = F.col("wanted").isNotNull() & F.col("got").isNotNull()
    unsupported = (F.col("got") == "active") & ~F.col("wanted").eqNullSafe(F.lit("active"))
    counts = matched.groupBy(*by).agg(
        F.count_if(both).alias("hits"), F.count_if(F.col("wanted").isNull()).alias("false_alarms"), F.count_if(F.col("got").isNull()).alias("misses"),
        F.count_if(both & (F.col("wanted") == F.col("got"))).alias("right_outcomes"), F.count_if(both & F.col("wanted_action").isNotNull()).alias("actions"),
        F.count_if(both & (F.col("wanted_action") == F.col("got_action"))).alias("right_actions"), F.count_if(F.col("got") == "active").alias("active"), F.count_if(unsupported).alias("unsupported"),
    )

    def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
        return F.when(whole > 0, part / whole.cast("double")).otherwise(F.lit(empty))

    c = F.col
    return counts.select(
        *by, "hits", "false_alarms", "misses", ratio(c("hits"), c("hits") + c("false_alarms")).alias("precision"), ratio(c("hits"), c("hits") + c("misses")).alias("recall"),
        ratio(c("right_outcomes"), c("hits")).alias("outcome_accuracy"), ratio(c("right_actions"), c("actions")).alias("action_accuracy"), ratio(c("unsupported"), c("active"), 0.0).alias("unsupported_rate"),
    )


def leaks_by_tag(candidates: DataFrame, returned: DataFrame) -> DataFrame:
    """candidates (query_id, id, tags) and returned (query_id, id): per tag the queries with a candidate so tagged, how many
    got one, and that share with its Wilson interval."""
    tagged = candidates.select("query_id", "id", F.explode("tags").alias("tag"))
    shown = returned.select("query_id", "id").distinct().withColumn("shown", F.lit(True))
    cases = tagged.join(shown, ["query_id", "id"], "left").groupBy("query_id", "tag").agg(F.max(F.coalesce("shown", F.lit(False))).alias("leaked"))
    counts = cases.groupBy("tag").agg(F.count("*").alias("cases"), F.count_if("leaked").alias("leaks"))
    return counts.select("tag", "cases", "leaks", scores.share_or_zero(F.col("leaks"), F.col("cases")).alias("rate"), scores.wilson(F.col("leaks"), F.col("cases")).alias("bounds"))


def retrieval_rows(hits: DataFrame, mapping: DataFrame, query: str) -> DataFrame:
    """One row for each query: its text hashed, and the facts of its hits in order of rank, each once, however often the mapping
    has it; hits without a fact are dropped. hits (query_id, query text, rank, id), at most a cut-off for each query; mapping
    (id, fact_id)."""
    mapped = hits.join(mapping.select("id", "fact_id"), "id")
    facts = F.transform(F.sort_array(F.collect_set(F.struct("rank", "fact_id"))), lambda x: x["fact_id"])
    return mapped.groupBy("query_id", F.sha2(F.col(query), 256).alias("query_hash")).agg(facts.alias("fact_ids"))
