"""Queries on shards, budgets, histories, reviews, claim identity and summary support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import calibration, recall, temporal, writing
from factloom.plans import analysis, lifecycle, views


def shard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation in its own shard and in that of each role."""
    rows = recall.in_shards(views.episodes(spark, sf_dir), "owner", "actor")
    return rows.groupBy("shard").agg(F.count("*").alias("documents"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.min("episode_id").alias("first_id"))


SHARD_MEMBERS = f"""WITH {views.EPISODES},
s AS (SELECT 'o:' || owner AS shard, * FROM v_episode UNION ALL SELECT 'o:' || owner || '|s:' || actor, * FROM v_episode WHERE actor IS NOT NULL)
SELECT shard, count(*) AS documents, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS chars, min(episode_id) AS first_id FROM s GROUP BY shard"""


def tier_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget of each customer's balance, clamped to 8 to 256, by the policy of the market segment."""
    c = views.read(spark, sf_dir, "customer")
    budget = F.least(F.lit(256), F.greatest(F.lit(8), F.floor(F.col("c_acctbal") / 40)))
    policy = F.when(F.col("c_mktsegment") == "BUILDING", "eager").when(F.col("c_mktsegment") == "MACHINERY", "disabled").otherwise("fallback")
    planned = c.select("c_custkey", budget.cast("bigint").alias("budget"), policy.alias("policy"))
    return planned.withColumn("b", recall.tier_budgets(F.col("budget"), F.col("policy"))).select("c_custkey", "budget", "policy", "b.*")


TIER_BUDGETS = """WITH p AS (SELECT c_custkey, CAST(least(256, greatest(8, floor(c_acctbal / 40))) AS BIGINT) AS budget,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'eager' WHEN 'MACHINERY' THEN 'disabled' ELSE 'fallback' END AS policy FROM customer),
h AS (SELECT *, CAST(greatest(1, CASE policy WHEN 'eager' THEN floor(budget * CAST(0.25 AS DOUBLE)) ELSE floor(budget * (CAST(1 AS DOUBLE) / 3)) END) AS BIGINT) AS h,
  CAST(greatest(1, CASE policy WHEN 'eager' THEN floor(budget * CAST(0.3 AS DOUBLE)) ELSE least(16, ceil(budget * (CAST(1 AS DOUBLE) / 3))) END) AS BIGINT) AS c FROM p)
SELECT c_custkey, budget, policy, CASE policy WHEN 'disabled' THEN 0 ELSE h END AS hot,
  CASE policy WHEN 'disabled' THEN 0 WHEN 'eager' THEN greatest(1, budget - h - c) ELSE greatest(1, budget - h) END AS warm,
  CASE policy WHEN 'disabled' THEN 0 ELSE c END AS cold, CAST(greatest(4, least(24, floor(budget / 4.0))) AS BIGINT) AS summaries FROM h"""


def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.feedback(spark, sf_dir)
    kept = recall.bounded_history(rows, "owner", 20, F.desc("seen_at"), F.desc("event_id"))
    return kept.select("owner", "event_id", "outcome", "place", "overflow")


BOUNDED_HISTORY = f"""WITH {views.FEEDBACK}
SELECT owner, event_id, outcome, CAST(row_number() OVER w AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY owner) - 20) AS overflow
FROM v_feedback WINDOW w AS (PARTITION BY owner ORDER BY seen_at DESC, event_id DESC) QUALIFY place <= 20"""


def feedback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.feedback_status(views.feedback(spark, sf_dir))


FEEDBACK_STATUS = f"""WITH {views.FEEDBACK} SELECT outcome, count(*) AS n, count(fact_id) AS named, count(*) FILTER (fact_id IS NULL) AS missing,
  min(seen_at) AS first_at, max(seen_at) AS last_at FROM v_feedback GROUP BY outcome"""


def label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as cases, against all quality labels."""
    cases = views.read(spark, sf_dir, "documents").where("lang = 'en'")
    return recall.label_states(cases, views.read(spark, sf_dir, "labels"), "doc_id", "quality")


LABEL_STATES = """WITH c AS (SELECT DISTINCT doc_id, true AS known FROM documents WHERE lang = 'en')
SELECT doc_id, quality, CASE WHEN known IS NULL THEN 'extra' WHEN quality IS NULL THEN 'missing' ELSE 'labelled' END AS state
FROM c FULL JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.feedback(spark, sf_dir).withColumn("day", F.to_date("seen_at"))
    return recall.reviews(rows, ["owner", "day"])


def review_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each user and day; its candidates are the facts that its events name."""
    return _reviews(spark, sf_dir).select("owner", "day", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), "confirmed")


_REVIEWS = f"""{views.FEEDBACK},
rf AS (SELECT owner, CAST(seen_at AS DATE) AS day, fact_id, bool_or(outcome IN ('adopted', 'corrected', 'denied')) AS l, bool_or(outcome = 'adopted') AS g, bool_or(outcome = 'denied') AS b
  FROM v_feedback WHERE fact_id IS NOT NULL GROUP BY ALL),
rv AS (SELECT owner, day, list_sort(list(fact_id)) AS candidates, bool_and(l) AND NOT bool_or(g AND b) AS confirmed FROM rf GROUP BY owner, day)"""
REVIEW_CONFIRMATION = f"WITH {_REVIEWS} SELECT owner, day, array_to_string(candidates, ',') AS candidates, confirmed FROM rv"


def feedback_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews after the facts whose keys are those of parts larger than 45 are erased."""
    erased = views.read(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("fact_id"))
    left = recall.purged_reviews(_reviews(spark, sf_dir), ["owner", "day"], erased)
    return left.select("owner", "day", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), "confirmed")


FEEDBACK_PURGE = f"""WITH {_REVIEWS}, x AS (SELECT DISTINCT p_partkey AS fact_id FROM part WHERE p_size > 45),
e AS (SELECT owner, day, confirmed, len(candidates) AS n, unnest(candidates) AS fact_id FROM rv),
k AS (SELECT owner, day, confirmed, n, list_sort(list(fact_id)) AS c FROM e WHERE fact_id NOT IN (SELECT fact_id FROM x) GROUP BY ALL)
SELECT owner, day, array_to_string(c, ',') AS candidates, confirmed AND len(c) = n AS confirmed FROM k"""


def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one identity, by polarity."""
    claims = views.claims(spark, sf_dir)
    key = recall.claim_key(F.lit("shared"), F.col("predicate"), {"subject": F.col("subject"), "object": F.col("object")})
    return claims.groupBy(key.alias("claim_key")).agg(F.count("*").alias("claims"), F.count_if(F.col("polarity") == "positive").alias("positive"), F.min("id").alias("first_id"))


CLAIM_KEYS = f"""WITH {views.CLAIMS}
SELECT sha256('6:shared' || length(predicate) || ':' || predicate || '6:object' || length(CAST(object AS VARCHAR)) || ':' || object || '7:subject' || length(CAST(subject AS VARCHAR)) || ':' || subject) AS claim_key, count(*) AS claims, count(*) FILTER (polarity = 'positive') AS positive, min(id) AS first_id
FROM v_claim GROUP BY 1"""


def summary_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as selected summaries, scored by their price, down to the orders that they support."""
    summaries = views.read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("summary_id"), F.least(F.lit(1.0), F.col("p_retailprice") / 2000).alias("score"))
    links = views.links(spark, sf_dir).where("active").withColumnRenamed("episode_id", "summary_id")
    found = recall.drilled_down(summaries, links)
    return found.select("fact_id", "summary_id", F.round("support", 6).alias("support"), "summaries")


SUMMARY_DRILLDOWN = f"""WITH {views.LINKS},
h AS (SELECT fact_id, episode_id AS summary_id, least(1.0, p_retailprice / 2000) * strength AS support FROM v_link JOIN part ON p_partkey = episode_id WHERE active AND p_size > 25),
r AS (SELECT *, count(*) OVER (PARTITION BY fact_id) AS summaries FROM h QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY support DESC, summary_id) = 1)
SELECT fact_id, summary_id, round(support, 6) AS support, summaries FROM r"""


def expired_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that last three years, on the first day of 1997."""
    rows = views.facts(spark, sf_dir).withColumn("until", F.col("valid_from") + F.expr("INTERVAL 3 YEARS"))
    return writing.expired(rows, "until", F.lit("1997-01-01").cast("timestamp")).select("owner", "fact_id", "status")


EXPIRED_FACTS = f"""WITH {views.FACTS}
SELECT owner, fact_id, CASE WHEN status = 'active' AND valid_from + INTERVAL 3 YEAR <= TIMESTAMP '1997-01-01' THEN 'expired' ELSE status END AS status FROM v_fact"""


def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that held on one day, as they were known on a later one: each is recorded, and closed, two days after it begins
    and ends."""
    rows = views.facts(spark, sf_dir).withColumns({"recorded_at": F.col("valid_from") + F.expr("INTERVAL 2 DAYS"), "closed_at": F.col("valid_to") + F.expr("INTERVAL 2 DAYS")})
    held = temporal.valid_at(F.lit("1995-03-15").cast("timestamp"), "valid_from", "valid_to") & temporal.visible_at(F.lit("1995-03-16").cast("timestamp"))
    return rows.where(held).select("owner", "fact_id", "value")


KNOWN_FACTS = f"""WITH {views.FACTS} SELECT owner, fact_id, value FROM v_fact
WHERE valid_from <= TIMESTAMP '1995-03-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-03-15')
  AND valid_from + INTERVAL 2 DAY <= TIMESTAMP '1995-03-16' AND (valid_to IS NULL OR valid_to + INTERVAL 2 DAY > TIMESTAMP '1995-03-16')"""


def accepted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations from suppliers to parts, accepted unless returned, as known at a time: each is recorded when it ships, and
    closed 60 days later."""
    li = views.read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").withColumn("closed", F.col("l_shipdate") + F.expr("INTERVAL 60 DAYS"))
    seen = li.where(temporal.visible_at(F.lit("1995-03-01").cast("timestamp"), "l_shipdate", "closed"))
    id = F.concat_ws("@", F.concat(F.lit("relation:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"))
    return seen.select(id.alias("id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linestatus").alias("kind"))


ACCEPTED_EDGES = """SELECT 'relation:' || l_orderkey || '@' || l_linenumber AS id, l_suppkey AS src, l_partkey AS dst, l_linestatus AS kind FROM lineitem
WHERE l_returnflag <> 'R' AND l_shipdate <= TIMESTAMP '1995-03-01' AND l_shipdate + INTERVAL 60 DAY > TIMESTAMP '1995-03-01'"""


def temporal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment and closeness of every fact to questions on a day, whose mode is that of its share."""
    rows = views.facts(spark, sf_dir)
    mode = F.when(F.col("share") == "never", "history").when(F.col("share") == "local-only", "current").otherwise("all")
    days = F.abs(F.datediff(F.lit("1995-06-30").cast("date"), F.col("valid_from").cast("date"))).cast("double")
    aligned = scores.temporal_alignment(mode, F.col("valid_to").isNotNull())
    return rows.select("fact_id", aligned.alias("alignment"), F.round(scores.temporal_closeness(aligned, days), 6).alias("closeness"))


TEMPORAL_SCORES = f"""WITH {views.FACTS},
a AS (SELECT fact_id, abs(date_diff('day', CAST(valid_from AS DATE), DATE '1995-06-30')) AS d, CASE share WHEN 'never' THEN CASE WHEN valid_to IS NOT NULL THEN 1.0 ELSE 0.2 END
  WHEN 'local-only' THEN CASE WHEN valid_to IS NOT NULL THEN 0.0 ELSE 1.0 END ELSE 0.7 END AS al FROM v_fact)
SELECT fact_id, CAST(al AS DOUBLE) AS alignment, round(CAST(0.7 AS DOUBLE) * al + CAST(0.3 AS DOUBLE) / (1 + d / CAST(365 AS DOUBLE)), 6) AS closeness FROM a"""


def sentence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are one sentence but for case, spaces and their final signs."""
    rows = views.episodes(spark, sf_dir).withColumn("key", F.sha2(text.sentence_key("content"), 256))
    return rows.groupBy("key").agg(F.count("*").alias("messages"), F.min("episode_id").alias("first_id"))


SENTENCE_KEYS = rf"""WITH {views.EPISODES}
SELECT sha256(regexp_replace(trim(regexp_replace(lower(coalesce(content, '')), '\s+', ' ', 'g')), '[.!?。！？]+$', '')) AS key, count(*) AS messages, min(episode_id) AS first_id FROM v_episode GROUP BY 1"""


def margin_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.margin_thresholds(views.samples(spark, sf_dir), ["cohort"])


MARGIN_THRESHOLDS = f"""WITH f AS ({analysis.THRESHOLD_FIT.replace("2.0 * fp", "3.0 * fp")}), {views.SAMPLES},
e AS (SELECT cohort, min(score) FILTER (relevant) AS low, max(score) FILTER (NOT relevant) AS high FROM v_sample GROUP BY cohort)
SELECT cohort, CASE WHEN coalesce(high < low, false) THEN (low + high) / 2 ELSE threshold END AS threshold, coalesce(high < low, false) AS clean FROM f JOIN e USING (cohort)"""


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.tier_assign(spark, sf_dir).groupBy("owner", "tier").agg(F.count("*").alias("facts"))


TIER_COUNTS = f"WITH t AS ({lifecycle.TIER_ASSIGN}) SELECT owner, tier, count(*) AS facts FROM t GROUP BY ALL"


def requirement_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.episodes(spark, sf_dir)
    return rows.select("episode_id", F.array_join(F.sort_array(text.requirement_tokens("content")), " ").alias("tokens"), F.size(text.feedback_tokens("content")).alias("feedback"), text.is_broad("content").alias("broad"))


def _pairs_sql(runs: str) -> str:
    return f"flatten(list_transform({runs}, lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i, 2))))"


_STOPS = ", ".join(f"'{s}'" for s in text.REQUIREMENT_STOPS)
_HAN = r"regexp_extract_all(t, '[\x{3400}-\x{9fff}]{2,}')"
REQUIREMENT_TOKENS = f"""WITH {views.EPISODES}, l AS (SELECT episode_id, lower(coalesce(content, '')) AS t FROM v_episode)
SELECT episode_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(t, '[a-z0-9][a-z0-9._-]+') || {_HAN} || {_pairs_sql(_HAN)}), lambda x: x NOT IN ({_STOPS}))), ' ') AS tokens,
  CAST(len(list_distinct(regexp_extract_all(t, '[a-z0-9@._+-]{{2,}}') || {_pairs_sql(_HAN)})) AS INTEGER) AS feedback, regexp_matches(t, '{"|".join(text.BROAD_PATTERNS)}') AS broad FROM l"""


QUERIES = {
    f.__name__: f
    for f in (
        shard_members, tier_budgets, bounded_history, feedback_status, label_states, review_confirmation, feedback_purge, claim_keys, summary_drilldown, expired_facts, known_facts, accepted_edges, temporal_scores,
        sentence_keys, margin_thresholds, tier_counts, requirement_tokens,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
