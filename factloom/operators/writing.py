"""Write path: evidence and durability scores, decisions, applying writes, expiry, unlinking, purges, migration, mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import stable_id

#: Weight of each kind of fact in durability, and the least scores of a decision.
KIND_WEIGHTS = {"identity": 1.0, "preference": 0.85, "project": 0.6, "event": 0.4}
LEAST_VERIFIED, LEAST_EVIDENCE, LEAST_DURABLE, LEAST_SUPERSEDE = 0.62, 0.55, 0.45, 0.72


def evidence_score(basis: Column, value: Column, source: Column, overlap: Column) -> Column:
    """By basis (image, confirmation, rules), else 1 if the value occurs in the source, else by token overlap."""
    return (
        F.when(basis == "image", 0.95).when(basis == "confirmation", 0.92).when(basis == "rules", 0.98)
        .when((F.length(value) > 0) & F.contains(F.lower(source), F.lower(value)), 1.0)
        .otherwise(F.least(F.lit(0.85), 0.15 + 0.7 * overlap))
    )


def durability(importance: Column, kind: Column, transient: Column, days_left: Column) -> Column:
    weight = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in KIND_WEIGHTS.items()), F.lit(0.5))
    near = F.when(days_left < 7, 0.35).when(days_left < 30, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * importance + 0.45 * weight - F.when(transient, 0.45).otherwise(0.0) - near))


def verification(extraction: Column, evidence: Column, durable: Column, clarity: Column) -> Column:
    return 0.25 * extraction + 0.45 * evidence + 0.2 * durable + 0.1 * clarity


def decision(safe: Column, verified: Column, evidence: Column, durable: Column, same_text: Column, same_value: Column, current_value: Column, value: Column, contradicts: Column) -> Column:
    """QUARANTINE, NOOP, MERGE_EVIDENCE, REFINE, SUPERSEDE, CONFLICT or ADD: the first that applies."""
    return (
        F.when(~safe | (evidence < LEAST_EVIDENCE) | (durable < LEAST_DURABLE) | (verified < LEAST_VERIFIED), "QUARANTINE")
        .when(same_text, "NOOP")
        .when(same_value, "MERGE_EVIDENCE")
        .when(current_value.isNull(), "ADD")
        .when(F.contains(F.lower(value), F.lower(current_value)), "REFINE")
        .when(verified >= LEAST_SUPERSEDE, "SUPERSEDE")
        .when(contradicts, "CONFLICT")
        .otherwise("QUARANTINE")
    )


def applied(candidates: DataFrame, by: list[str], at: str, id: str, value: str, confidence: str, least: float = 0.8) -> DataFrame:
    """A batch of writes on single-valued keys, resolved in time order: equal values in a row merge into the first, which
    takes their highest confidence and their number; a later other value closes the one before if it is confident
    enough, else it is conflicted and closes nothing."""
    w = Window.partitionBy(*by).orderBy(at, id)
    strong = F.col(confidence) >= least
    rows = candidates.withColumn("_conflicted", ~strong & (F.row_number().over(w) > 1))
    good = rows.where("not _conflicted").withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    good = good.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = good.groupBy(*by, "_run").agg(
        F.min(F.struct(at, id)).alias("f"), F.first(value).alias(value), F.max(confidence).alias(confidence), F.count("*").alias("sources")
    )
    out = merged.select(*by, F.col("f")[id].alias(id), F.col("f")[at].alias(at), value, confidence, "sources")
    after = F.lead(at).over(Window.partitionBy(*by).orderBy(at, id))
    out = out.withColumns({"valid_to": F.when(after.isNotNull(), F.greatest(after, F.col(at) + F.expr("INTERVAL 1 SECOND"))), "status": F.when(after.isNull(), "active").otherwise("superseded")})
    left = rows.where("_conflicted").select(*by, id, at, value, confidence, F.lit(1).cast("bigint").alias("sources"), F.lit(None).cast(candidates.schema[at].dataType).alias("valid_to"), F.lit("conflicted").alias("status"))
    return out.unionByName(left)


def expired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    return rows.withColumn("status", F.when((F.col("status") == "active") & (F.col(expires) <= now), "expired").otherwise(F.col("status")))


def unlinked(facts: DataFrame, links: DataFrame, gone: DataFrame) -> DataFrame:
    """facts (fact_id, status) after the episodes in `gone` went: facts whose last active evidence is lost are orphaned."""
    left = links.where("active").join(gone, "episode_id", "left_anti").select("fact_id").distinct().withColumn("held", F.lit(True))
    touched = links.where("active").join(gone, "episode_id").select("fact_id").distinct().withColumn("touched", F.lit(True))
    rows = facts.join(touched, "fact_id", "left").join(left, "fact_id", "left")
    orphan = (F.col("status") == "active") & F.col("touched").isNotNull() & F.col("held").isNull()
    return rows.withColumn("status", F.when(orphan, "orphaned").otherwise(F.col("status"))).drop("touched", "held")


def purge_plan(links: DataFrame, purged: DataFrame) -> DataFrame:
    """(episode_id, action) for the episodes of purged facts: erased if no other fact uses them, else kept."""
    used = links.join(purged.withColumn("goes", F.lit(True)), "fact_id", "left").groupBy("episode_id").agg(F.count_if(F.col("goes")).alias("gone"), F.count_distinct(F.when(F.col("goes").isNull(), F.col("fact_id"))).alias("others"))
    return used.where("gone > 0").select("episode_id", F.when(F.col("others") == 0, "erase").otherwise("keep").alias("action"), "others")


def migrated(rows: DataFrame, namespace: str = "migration") -> DataFrame:
    """Flat records (fact_id, owner, text, status, automatic, sources array) fanned out in one pass: the fact, its first
    version, an episode and a link for each source, and a warning for what could not be taken over, as (kind, id, ref)."""
    status = F.when((F.col("status") == "active") & F.col("automatic"), "quarantined").otherwise(F.col("status"))
    one = lambda kind, id, ref: F.array(F.struct(F.lit(kind).alias("kind"), id.alias("id"), ref.cast("string").alias("ref")))
    fact = stable_id(namespace, F.lit("fact"), "fact_id")
    per_source = F.transform("sources", lambda s: F.struct(F.lit("episode").alias("kind"), stable_id(namespace, F.lit("episode"), s.cast("string")).alias("id"), s.cast("string").alias("ref")))
    per_link = F.transform("sources", lambda s: F.struct(F.lit("link").alias("kind"), stable_id(namespace, F.lit("link"), F.col("fact_id").cast("string"), s.cast("string")).alias("id"), s.cast("string").alias("ref")))
    warned = F.when(F.size("sources") == 0, one("warning", fact, F.lit("no-source"))).otherwise(F.array().cast("array<struct<kind:string,id:string,ref:string>>"))
    every = F.concat(one("fact", fact, status), one("version", stable_id(namespace, F.lit("version"), "fact_id", F.lit("1")), F.lit("1")), per_source, per_link, warned)
    return rows.select(F.col("fact_id").alias("source_id"), F.explode(every).alias("r")).select("source_id", "r.*").dropDuplicates(["kind", "id"])


def merged_candidates(parts: list[DataFrame], key: Column) -> DataFrame:
    """Union of candidate tables (content, channel, seq, ...) by a key of the content: the last row wins, channels are joined."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    g = union.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct("content", "seq"), "seq").alias("last"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channel"), F.count("*").alias("n"))
    return g.select(F.col("_key").alias("key"), "last.content", "last.seq", "channel", "n")
