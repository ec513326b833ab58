"""Queries on planning questions, write decisions, merges, cascades, migration and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import planning, text
from factloom.operators import graph, writing
from factloom.plans import views

TODAY = "1998-05-20"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order, in several forms around its date."""
    o = views.read(spark, sf_dir, "orders")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 10
    q = (
        F.when(k == 0, F.concat(F.lit("what was due in "), F.substring(d, 1, 4)))
        .when(k == 1, F.concat(F.lit("list all orders of "), F.substring(d, 1, 7)))
        .when(k == 2, F.concat(F.lit("what came on "), d))
        .when(k == 3, F.concat(F.lit("what came from "), d, F.lit(" to 1999-12-31 and why")))
        .when(k == 4, F.concat(F.lit("status as of "), d))
        .when(k == 5, F.concat(F.lit("what came on 1996-13-"), F.substring(d, 9, 2)))
        .when(k == 6, F.concat(F.lit("what came in the last "), (F.col("o_orderkey") % 40 + 1).cast("string"), F.lit(" weeks")))
        .when(k == 7, F.lit("what did it used to be"))
        .when(k == 8, F.lit("compare this year and last month; then tell me?"))
        .otherwise(F.lit("what is the status"))
    )
    return o.select(F.col("o_orderkey").alias("query_id"), q.alias("text"))


def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, as-of point, temporal mode, intent and budget of every question."""
    t, today = F.col("text"), F.lit(TODAY).cast("date")
    rows = _questions(spark, sf_dir).withColumns({"e": planning.explicit_range(t), "r": planning.relative_range(t, today), "intent": planning.intent(t)})
    return rows.select(
        "query_id", F.coalesce("e.low", "r.low").alias("low"), F.coalesce("e.high", "r.high").alias("high"), planning.as_of_point(t).alias("as_of"), planning.temporal_mode(t, today).alias("mode"), "intent",
        planning.budget(F.col("intent")).alias("candidates"), F.size(planning.clauses(t)).alias("clauses"),
    )


QUESTION_PLANS = f"""WITH q AS (SELECT o_orderkey AS query_id, o_orderkey % 10 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
x AS (SELECT *, CASE k WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN d WHEN 6 THEN DATE '{TODAY}' - CAST(7 * (query_id % 40 + 1) AS INTEGER) WHEN 8 THEN DATE '1998-01-01' END AS lo,
  CASE k WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 2 THEN d + INTERVAL 1 DAY WHEN 3 THEN DATE '2000-01-01' WHEN 4 THEN d + INTERVAL 1 DAY WHEN 6 THEN DATE '1998-05-21' WHEN 8 THEN DATE '1999-01-01' END AS hi FROM q WHERE NOT (k = 3 AND d > DATE '1999-12-31') UNION ALL SELECT *, NULL, NULL FROM q WHERE k = 3 AND d > DATE '1999-12-31')
SELECT query_id, CAST(lo AS DATE) AS low, CAST(hi AS DATE) AS high, CASE WHEN k = 4 THEN CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR END AS as_of,
  CASE WHEN k = 4 THEN 'as-of' WHEN lo IS NOT NULL THEN 'range' WHEN k = 7 THEN 'history' ELSE 'current' END AS mode,
  CASE WHEN k = 1 THEN 'enumerative' WHEN k IN (0, 2, 3, 4, 5, 7) THEN 'temporal' WHEN k = 8 THEN 'multi-fact' ELSE 'specific' END AS intent,
  CASE WHEN k = 1 THEN 80 WHEN k IN (0, 2, 3, 4, 5, 7) THEN 48 WHEN k = 8 THEN 40 ELSE 24 END AS candidates,
  CASE WHEN k = 3 THEN 2 WHEN k = 8 THEN 3 ELSE 1 END AS clauses FROM x"""


def write_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a proposed value against its owner's value before it: scores and decision."""
    w = Window.partitionBy("owner").orderBy("valid_from", "fact_id")
    rows = views.facts(spark, sf_dir).withColumns({"kind": F.when(F.col("fact_id") % 4 == 0, "identity").when(F.col("fact_id") % 4 == 1, "project").otherwise("event"), "overlap": (F.col("fact_id") % 11) / 10.0, "current": F.lag("value").over(w)})
    rows = rows.withColumn("evidence", writing.evidence_score(F.when(F.col("fact_id") % 5 == 0, "rules").otherwise("model"), F.lit(""), F.lit(""), F.col("overlap")))
    rows = rows.withColumn("durable", writing.durability(F.col("importance"), F.col("kind"), F.col("fact_id") % 13 == 0, F.lit(90)))
    rows = rows.withColumn("verified", F.round(writing.verification(F.lit(0.9), F.col("evidence"), F.col("durable"), F.lit(1.0)), 6))
    act = writing.decision(
        F.col("share") != "never", F.col("verified"), F.col("evidence"), F.col("durable"), (F.col("current") == F.col("value")) & (F.col("fact_id") % 2 == 0), F.coalesce(F.col("current") == F.col("value"), F.lit(False)), F.col("current"), F.col("value"), F.col("current") == "F"
    )
    return rows.withColumn("decision", act).groupBy("owner", "decision").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"))


WRITE_DECISIONS = f"""WITH {views.FACTS},
a AS (SELECT *, lag(value) OVER (PARTITION BY owner ORDER BY valid_from, fact_id) AS cur, CASE WHEN fact_id % 5 = 0 THEN 0.98 ELSE least(0.85, 0.15 + 0.7 * ((fact_id % 11) / 10.0)) END AS ev,
  greatest(0.0, least(1.0, 0.55 * importance + 0.45 * CASE WHEN fact_id % 4 = 0 THEN 1.0 WHEN fact_id % 4 = 1 THEN 0.6 ELSE 0.4 END - CASE WHEN fact_id % 13 = 0 THEN 0.45 ELSE 0.0 END)) AS du FROM v_fact),
b AS (SELECT *, round(0.25 * 0.9 + 0.45 * ev + 0.2 * du + 0.1, 6) AS ve FROM a),
c AS (SELECT owner, fact_id, CASE WHEN share = 'never' OR ev < 0.55 OR du < 0.45 OR ve < 0.62 THEN 'QUARANTINE' WHEN cur = value AND fact_id % 2 = 0 THEN 'NOOP' WHEN cur = value THEN 'MERGE_EVIDENCE' WHEN cur IS NULL THEN 'ADD'
  WHEN contains(lower(value), lower(cur)) THEN 'REFINE' WHEN ve >= 0.72 THEN 'SUPERSEDE' WHEN cur = 'F' THEN 'CONFLICT' ELSE 'QUARANTINE' END AS decision FROM b)
SELECT owner, decision, count(*) AS n, min(fact_id) AS first_id FROM c GROUP BY ALL"""


def applied_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.facts(spark, sf_dir).select("owner", "fact_id", "valid_from", "value", F.round(F.lit(1.0) - (F.col("fact_id") % 7) / 20.0, 2).alias("confidence"))
    return writing.applied(rows, ["owner"], "valid_from", "fact_id", "value", "confidence").select("owner", "fact_id", "value", "confidence", "sources", "valid_to", "status")


APPLIED_WRITES = f"""WITH {views.FACTS},
c AS (SELECT owner, fact_id, valid_from, value, round(1.0 - (fact_id % 7) / 20.0, 2) AS confidence, row_number() OVER (PARTITION BY owner ORDER BY valid_from, fact_id) AS n FROM v_fact),
g AS (SELECT *, coalesce(CAST(value <> lag(value) OVER (PARTITION BY owner ORDER BY valid_from, fact_id) AS INT), 1) AS ch FROM c WHERE confidence >= 0.8 OR n = 1),
r AS (SELECT *, sum(ch) OVER (PARTITION BY owner ORDER BY valid_from, fact_id) AS run FROM g),
m AS (SELECT owner, run, arg_min(fact_id, (valid_from, fact_id)) AS fact_id, min(valid_from) AS valid_from, any_value(value) AS value, max(confidence) AS confidence, count(*) AS sources FROM r GROUP BY owner, run),
o AS (SELECT *, lead(valid_from) OVER (PARTITION BY owner ORDER BY valid_from, fact_id) AS nxt FROM m)
SELECT owner, fact_id, value, confidence, sources, greatest(nxt, CASE WHEN nxt IS NOT NULL THEN valid_from + INTERVAL 1 SECOND END) AS valid_to, CASE WHEN nxt IS NULL THEN 'active' ELSE 'superseded' END AS status FROM o
UNION ALL SELECT owner, fact_id, value, confidence, 1, NULL, 'conflicted' FROM c WHERE confidence < 0.8 AND n > 1"""


def unlink_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by status after every episode (part) whose id is divisible by 3 or 5 went."""
    gone = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("episode_id")).where("episode_id % 3 = 0 or episode_id % 5 = 0")
    out = writing.unlinked(views.facts(spark, sf_dir).select("fact_id", "owner", "status"), views.links(spark, sf_dir), gone)
    return out.groupBy("status").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"))


UNLINK_CASCADE = f"""WITH {views.FACTS}, {views.LINKS},
t AS (SELECT fact_id, bool_or(episode_id % 3 = 0 OR episode_id % 5 = 0) AS touched, bool_or(NOT (episode_id % 3 = 0 OR episode_id % 5 = 0)) AS held FROM v_link WHERE active GROUP BY fact_id),
s AS (SELECT f.fact_id, CASE WHEN status = 'active' AND coalesce(touched, false) AND NOT coalesce(held, false) THEN 'orphaned' ELSE status END AS status FROM v_fact f LEFT JOIN t USING (fact_id))
SELECT status, count(*) AS n, min(fact_id) AS first_id FROM s GROUP BY status"""


def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    purged = views.facts(spark, sf_dir).where("owner % 9 = 0").select("fact_id")
    return writing.purge_plan(views.links(spark, sf_dir), purged)


PURGE_PLAN = f"""WITH {views.FACTS}, {views.LINKS}, p AS (SELECT fact_id FROM v_fact WHERE owner % 9 = 0),
u AS (SELECT episode_id, count(*) FILTER (p.fact_id IS NOT NULL) AS gone, count(DISTINCT l.fact_id) FILTER (p.fact_id IS NULL) AS others FROM v_link l LEFT JOIN p USING (fact_id) GROUP BY episode_id)
SELECT episode_id, CASE WHEN others = 0 THEN 'erase' ELSE 'keep' END AS action, others FROM u WHERE gone > 0"""


def migration_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.links(spark, sf_dir).where("active").groupBy("fact_id").agg(F.array_sort(F.collect_set("episode_id")).alias("sources"))
    rows = views.facts(spark, sf_dir).join(sources, "fact_id", "left").select("fact_id", "owner", "value", "status", (F.col("fact_id") % 2 == 0).alias("automatic"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))
    return writing.migrated(rows).groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


MIGRATION_FANOUT = f"""WITH {views.FACTS}, {views.LINKS},
s AS (SELECT DISTINCT fact_id, episode_id FROM v_link WHERE active AND fact_id IN (SELECT fact_id FROM v_fact)),
r AS (
  SELECT 'fact' AS kind, 'migration' || chr(10) || 'fact' || chr(10) || fact_id AS k FROM v_fact UNION ALL SELECT 'version', 'migration' || chr(10) || 'version' || chr(10) || fact_id || chr(10) || '1' FROM v_fact
  UNION ALL SELECT DISTINCT 'episode', 'migration' || chr(10) || 'episode' || chr(10) || episode_id FROM s UNION ALL SELECT 'link', 'migration' || chr(10) || 'link' || chr(10) || fact_id || chr(10) || episode_id FROM s
  UNION ALL SELECT 'warning', 'migration' || chr(10) || 'fact' || chr(10) || fact_id FROM v_fact WHERE fact_id NOT IN (SELECT fact_id FROM s)
)
SELECT kind, count(*) AS n, min(substring(sha256(k), 1, 24)) AS first_id, max(substring(sha256(k), 1, 24)) AS last_id FROM r GROUP BY kind"""


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of users and of assistants as two candidate sources, united by their comparable text."""
    rows = views.episodes(spark, sf_dir).where("actor <> 'system'").select("episode_id", "actor", F.explode(F.split("content", r"\.")).alias("content"))
    rows = rows.where(F.length(F.trim("content")) > 0).groupBy(text.comparable("content").alias("k"), "actor").agg(F.max("episode_id").alias("seq"))
    part = lambda a, c: rows.where(F.col("actor") == a).select(F.col("k").alias("content"), F.lit(c).alias("channel"), "seq")
    return writing.merged_candidates([part("user", "rule"), part("assistant", "model")], F.col("content")).where("key <> ''").select("key", "seq", "channel", "n")


CANDIDATE_UNION = rf"""WITH {views.EPISODES},
s AS (SELECT episode_id, actor, unnest(string_split(content, '.')) AS c FROM v_episode WHERE actor <> 'system'),
k AS (SELECT regexp_replace(lower(c), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key, actor, max(episode_id) AS seq FROM s WHERE length(trim(c)) > 0 GROUP BY ALL)
SELECT key, max(seq) AS seq, string_agg(DISTINCT CASE actor WHEN 'user' THEN 'rule' ELSE 'model' END, '+' ORDER BY CASE actor WHEN 'user' THEN 'rule' ELSE 'model' END) AS channel, count(*) AS n FROM k WHERE key <> '' GROUP BY key"""


def feedback_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each (owner, fact): the newest wins; pairs with both verdicts on one day are in conflict and left out."""
    rows = views.feedback(spark, sf_dir).where("outcome in ('adopted', 'denied') and fact_id is not null").withColumn("day", F.to_date("seen_at"))
    clash = rows.groupBy("owner", "fact_id", "day").agg(F.count_distinct("outcome").alias("v")).where("v > 1").select("owner", "fact_id").distinct()
    newest = rows.groupBy("owner", "fact_id").agg(F.max_by("outcome", F.struct("seen_at", "event_id")).alias("label"), F.count("*").alias("reviews"))
    return newest.join(clash, ["owner", "fact_id"], "left_anti")


FEEDBACK_FREEZE = f"""WITH {views.FEEDBACK}, r AS (SELECT *, CAST(seen_at AS DATE) AS day FROM v_feedback WHERE outcome IN ('adopted', 'denied') AND fact_id IS NOT NULL),
c AS (SELECT DISTINCT owner, fact_id FROM r GROUP BY owner, fact_id, day HAVING count(DISTINCT outcome) > 1)
SELECT owner, fact_id, arg_max(outcome, (seen_at, event_id)) AS label, count(*) AS reviews FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.owner = r.owner AND c.fact_id = r.fact_id) GROUP BY owner, fact_id"""


def policy_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as policies with size and price: those that no other one beats on both, by a running minimum, no self join."""
    p = views.read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.round(F.min("p_retailprice"), 2).alias("price"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("price").over(w)
    return p.withColumn("_b", best).where(F.col("_b").isNull() | (F.col("price") < F.col("_b"))).drop("_b")


POLICY_FRONTIER = """WITH p AS (SELECT p_brand, p_size, round(min(p_retailprice), 2) AS price FROM part GROUP BY ALL)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_brand = p.p_brand AND o.p_size > p.p_size AND o.price <= p.price)"""


def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim pairs of one order or of one subject and supplier, newer first, at most 32 partners of a claim."""
    c = views.claims(spark, sf_dir).groupBy("id").agg(F.min("valid_from").alias("at"), F.min("subject").alias("s"), F.min("object").alias("o"))
    claims = c.select("id", "at", F.floor(F.col("id") / 10).cast("string").alias("episode"), F.concat_ws(":", "s", "o").alias("argument"))
    return graph.relation_pairs(claims, ["episode", "argument"]).select("id", "other", F.array_join("routes", "+").alias("routes"), "rank")


RELATION_PAIRS = f"""WITH {views.CLAIMS},
c AS (SELECT id, min(valid_from) AS at_, id // 10 AS episode, min(subject) || ':' || min(object) AS argument FROM v_claim GROUP BY id),
u AS (SELECT x.id, y.id AS other, 'episode' AS route FROM c x JOIN c y ON x.episode = y.episode AND (x.at_, x.id) > (y.at_, y.id) UNION ALL SELECT x.id, y.id, 'argument' FROM c x JOIN c y ON x.argument = y.argument AND (x.at_, x.id) > (y.at_, y.id)),
g AS (SELECT id, other, string_agg(DISTINCT route, '+' ORDER BY route) AS routes, count(DISTINCT route) AS n FROM u GROUP BY id, other)
SELECT id, other, routes, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS INTEGER) AS rank FROM g QUALIFY rank <= 32"""

QUERIES = {
    f.__name__: f for f in (question_plans, write_decisions, applied_writes, unlink_cascade, purge_plan, migration_fanout, candidate_union, feedback_freeze, policy_frontier, relation_pairs)
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
