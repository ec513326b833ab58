"""Queries on entity linking, evidence packs, routing, consolidation, mirrors and calibrated confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.scores import share_or_zero
from factloom.operators import claims, lexical
from factloom.plans import retrieval, views


def entity_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments and nations as mentions of nations and regions, by name or by an alias."""
    nations = views.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("entity_id"), F.col("n_name").alias("name"), F.lit("place").alias("type"), F.substring("n_name", 1, 3).alias("alias"))
    regions = views.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("entity_id"), F.col("r_name").alias("name"), F.lit("place").alias("type"), F.substring("r_name", 1, 3).alias("alias"))
    c = views.read(spark, sf_dir, "customer").join(views.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 4 == 0, F.substring("n_name", 1, 3)).when(F.col("c_custkey") % 4 == 1, F.lower("n_name")).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("  "), F.col("n_name"))).otherwise(F.col("c_mktsegment"))
    linked = claims.linked_entities(c.select(F.col("c_custkey").alias("mention_id"), text.alias("text"), F.lit("place").alias("type")), nations.unionByName(regions))
    return linked.groupBy("basis", "entity_id").agg(F.count("*").alias("n"))


ENTITY_LINKING = r"""WITH e AS (SELECT n_nationkey + 100 AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region),
k AS (SELECT id, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS k, 1 AS basis FROM e UNION ALL SELECT id, trim(regexp_replace(lower(substring(name, 1, 3)), '\s+', ' ', 'g')), 2 FROM e),
g AS (SELECT k, basis, count(DISTINCT id) AS n, min(id) AS id FROM k GROUP BY k, basis QUALIFY row_number() OVER (PARTITION BY k ORDER BY basis) = 1),
m AS (SELECT CASE c_custkey % 4 WHEN 0 THEN substring(n_name, 1, 3) WHEN 1 THEN lower(n_name) WHEN 2 THEN '  ' || n_name ELSE c_mktsegment END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
j AS (SELECT CASE WHEN g.k IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN basis = 1 THEN 'name' ELSE 'alias' END AS basis, CASE WHEN n = 1 THEN g.id END AS entity_id FROM m LEFT JOIN g ON g.k = trim(regexp_replace(lower(text), '\s+', ' ', 'g')))
SELECT basis, entity_id, count(*) AS n FROM j GROUP BY basis, entity_id"""


def predicate_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("A", "supplies", False), ("R", "supplies", True)], "name string, canonical string, reversed boolean")
    out = claims.directed(views.claims(spark, sf_dir), registry)
    return out.groupBy("predicate", "canonical", "reason").agg(F.count("*").alias("n"), F.sum("from_id").alias("from_sum"), F.sum("to_id").alias("to_sum"))


PREDICATE_DIRECTION = f"""WITH {views.CLAIMS}
SELECT predicate, CASE WHEN predicate IN ('A', 'R') THEN 'supplies' END AS canonical, CASE WHEN predicate NOT IN ('A', 'R') THEN 'unknown-predicate' END AS reason, count(*) AS n,
  CAST(sum(CASE WHEN predicate = 'R' THEN object ELSE subject END) AS BIGINT) AS from_sum, CAST(sum(CASE WHEN predicate = 'R' THEN subject ELSE object END) AS BIGINT) AS to_sum FROM v_claim GROUP BY predicate"""


def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.conflict_groups(views.facts(spark, sf_dir), ["owner"], "fact_id")
    return rows.select("owner", "fact_id", F.array_join("conflict_ids", ",").alias("conflict_ids"))


CONFLICT_GROUPS = f"""WITH {views.FACTS}, n AS (SELECT owner, fact_id, list(fact_id) OVER (PARTITION BY owner ORDER BY valid_from, fact_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM v_fact)
SELECT owner, fact_id, array_to_string(list_slice(list_sort(list_filter(near, lambda x: x <> fact_id)), 1, 8), ',') AS conflict_ids FROM n"""


def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical.top_per(retrieval._bm25(spark, sf_dir), ["query_id"], 5, F.desc("score"), F.asc("id")).select("query_id", "id", "rank")
    facts = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    packs = claims.evidence_pack(top, facts)
    return packs.select("query_id", "n", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["citation"], e["id"].cast("string"), e["lang"], e["source"])), " ").alias("entries"))


EVIDENCE_PACKS = f"""WITH {retrieval._bm25_sql()},
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 5)
SELECT query_id, count(*) AS n, string_agg('M' || rank || ':' || id || ':' || lang || ':' || source, ' ' ORDER BY rank) AS entries FROM r JOIN documents ON id = doc_id GROUP BY query_id"""


def read_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners' reads: active facts first, then superseded ones."""
    facts = views.facts(spark, sf_dir).select(F.col("owner").alias("query_id"), "status", "share", "value")
    asked = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    primary = facts.where("status = 'active' and value = 'O' and share = 'allow-remote'")
    return claims.routed_reads(asked, primary, facts.where("status = 'superseded' and value = 'F'")).groupBy("served", "reason").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


READ_ROUTING = f"""WITH {views.FACTS},
p AS (SELECT owner, count(*) AS p FROM v_fact WHERE status = 'active' AND value = 'O' AND share = 'allow-remote' GROUP BY owner), s AS (SELECT owner, count(*) AS s FROM v_fact WHERE status = 'superseded' AND value = 'F' GROUP BY owner),
j AS (SELECT coalesce(p, 0) AS p, coalesce(s, 0) AS s FROM customer LEFT JOIN p ON p.owner = c_custkey LEFT JOIN s ON s.owner = c_custkey)
SELECT CASE WHEN p > 0 THEN 'primary' WHEN s > 0 THEN 'secondary' ELSE 'none' END AS served, CASE WHEN p = 0 THEN 'empty' END AS reason, count(*) AS n, CAST(sum(CASE WHEN p > 0 THEN p ELSE s END) AS BIGINT) AS rows FROM j GROUP BY ALL"""


def consolidation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of users' days against those of a run that saw the events up to the 20th day only."""
    rows = views.feedback(spark, sf_dir).withColumn("week", F.weekofyear("seen_at"))
    group = lambda df: df.groupBy("owner", "week").agg(F.collect_set("fact_id").alias("members"))
    out = claims.consolidation_actions(group(rows), group(rows.where("day(seen_at) <= 20 or owner % 2 = 0")), ["owner", "week"], "members")
    return out.groupBy("action", "week").agg(F.count("*").alias("n"))


CONSOLIDATION_DIFF = f"""WITH {views.FEEDBACK}, r AS (SELECT *, weekofyear(seen_at) AS week FROM v_feedback),
w AS (SELECT owner, week, list_sort(list(DISTINCT fact_id)) AS m FROM r GROUP BY ALL), p AS (SELECT owner, week, list_sort(list(DISTINCT fact_id)) AS m FROM r WHERE day(seen_at) <= 20 OR owner % 2 = 0 GROUP BY ALL),
j AS (SELECT coalesce(w.week, p.week) AS week, CASE WHEN w.m IS NULL THEN 'prune' WHEN p.m IS NULL THEN 'build' WHEN w.m = p.m THEN 'skip' ELSE 'rebuild' END AS action FROM w FULL JOIN p ON w.owner = p.owner AND w.week = p.week)
SELECT action, CAST(week AS INTEGER) AS week, count(*) AS n FROM j GROUP BY ALL"""


def mirror_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of an incremental mirror: the current table holds purged, archived, changed and vanished rows."""
    facts = views.facts(spark, sf_dir).select("fact_id", "value", "status")
    current = facts.where("fact_id % 17 <> 0").select(
        "fact_id", F.when(F.col("fact_id") % 5 == 0, "X").otherwise(F.col("value")).alias("value"), F.when(F.col("fact_id") % 19 == 0, "purged").when(F.col("fact_id") % 10 == 0, "archived").otherwise(F.col("status")).alias("status")
    )
    out = claims.mirror_merge(current, facts.where("fact_id % 23 <> 0"), "fact_id", F.col("c.status") == "purged", F.col("c.status") == "archived", F.col("i.status") == "active")
    return out.groupBy("action").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"), F.max("fact_id").alias("last_id"))


MIRROR_UPDATE = f"""WITH {views.FACTS},
c AS (SELECT fact_id, CASE WHEN fact_id % 5 = 0 THEN 'X' ELSE value END AS cv, CASE WHEN fact_id % 19 = 0 THEN 'purged' WHEN fact_id % 10 = 0 THEN 'archived' ELSE status END AS cs FROM v_fact WHERE fact_id % 17 <> 0),
i AS (SELECT fact_id, value AS iv, status AS istat FROM v_fact WHERE fact_id % 23 <> 0),
j AS (SELECT fact_id, CASE WHEN cs IS NULL THEN 'insert' WHEN cs = 'purged' THEN 'keep-purged' WHEN istat IS NULL THEN 'delete' WHEN cv = iv AND cs = istat THEN 'unchanged' WHEN cs = 'archived' AND istat <> 'active' THEN 'keep-archived' ELSE 'update' END AS action FROM c FULL JOIN i USING (fact_id))
SELECT action, count(*) AS n, min(fact_id) AS first_id, max(fact_id) AS last_id FROM j GROUP BY action"""


def history_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one subject and supplier whose validity runs into the next one's."""
    w = Window.partitionBy("subject", "object").orderBy("valid_from", "id")
    rows = views.claims(spark, sf_dir).withColumn("next_from", F.lead("valid_from").over(w))
    return rows.where("next_from < valid_to").groupBy("predicate").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


HISTORY_OVERLAPS = f"""WITH {views.CLAIMS}, n AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, object ORDER BY valid_from, id) AS next_from FROM v_claim)
SELECT predicate, count(*) AS n, min(id) AS first_id FROM n WHERE next_from < valid_to GROUP BY predicate"""


def abstention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases whose best raw score is below the threshold of their kind abstain; how often that is right."""
    index = retrieval._index(spark, sf_dir)
    best = retrieval._bm25(spark, sf_dir, index=index).groupBy("query_id").agg(F.max("score").alias("best"))
    held = retrieval._relevant(spark, sf_dir, index).select(F.col("case_id").alias("query_id")).distinct().withColumn("known", F.lit(True))
    rows = views.benchmark_queries(spark, sf_dir).join(best, "query_id", "left").join(held, "query_id", "left")
    least = F.when(F.col("query_id") % 3 == 0, 25.0).when(F.col("query_id") % 3 == 1, 22.0).otherwise(20.0)
    g = rows.select((F.coalesce("best", F.lit(0.0)) < least).alias("abstains"), F.coalesce("known", F.lit(False)).alias("answerable")).groupBy("abstains").agg(F.count("*").alias("n"), F.count_if("answerable").alias("answerable"))
    return g.withColumn("share", F.round(share_or_zero(F.col("answerable"), F.col("n")), 6))


ABSTENTION_GATE = f"""WITH {retrieval._bm25_sql()}, {retrieval._RELEVANT}, b AS (SELECT query_id, max(score) AS best FROM bm GROUP BY query_id),
r AS (SELECT coalesce(best, 0) < CASE query_id % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 22.0 ELSE 20.0 END AS abstains, query_id IN (SELECT case_id FROM relevant) AS answerable FROM v_query LEFT JOIN b USING (query_id))
SELECT abstains, count(*) AS n, count(*) FILTER (answerable) AS answerable, round(count(*) FILTER (answerable) / count(*), 6) AS share FROM r GROUP BY abstains"""


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.isotonic_blocks(views.samples(spark, sf_dir), "cohort").select("cohort", "low", "high", F.round("value", 6).alias("value"), "weight")


QUERIES = {
    f.__name__: f for f in (entity_linking, predicate_direction, conflict_groups, evidence_packs, read_routing, consolidation_diff, mirror_update, history_overlaps, abstention_gate, isotonic_fit)
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
