"""Queries on hierarchical recall and tier routing over the facts that messages state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import cues
from factloom.operators import hierarchical, hybrid
from factloom.plans import hybrid as plans


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of messages with a tier by age; some have none assigned, a few are held back."""
    age, id = F.col("age_days"), F.col("id")
    assigned = F.when(id % 23 == 0, "quarantine").when(id % 17 == 0, None).when(age < 200, "hot").when(age < 500, "warm").otherwise("cold")
    utility = F.round(0.5 * F.col("importance") + 0.3 * F.col("confidence") + 0.2 * hybrid.recency(F.col("kind"), age), 6)
    return plans.facts(spark, sf_dir).withColumns({"assigned": assigned, "utility": utility})


def summaries(facts: DataFrame) -> DataFrame:
    """One summary of the active facts of each owner and kind."""
    rows = facts.where("status = 'active'").groupBy("owner", "kind").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("f"))
    return rows.select("owner", F.concat_ws("/", "owner", "kind").alias("id"), F.concat(F.col("kind"), F.lit("："), F.array_join("f.content", "；")).alias("content"), F.col("f.id").alias("facts"))


def recall_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with evidence enough for every question, the stage that found them and their tier."""
    held = hierarchical.keyed(facts(spark, sf_dir), "facts-tiers")
    asked = hierarchical.routed(hybrid.planned(plans.requests(spark, sf_dir)))
    out = hierarchical.recalled(asked, hierarchical.Index(held, summaries(held)))
    return out.select("request_id", "id", "tier", "rank", F.round("score", 5).alias("score"), F.round("evidence", 5).alias("evidence"), F.array_join("routes", ",").alias("routes"), "stage")


def tier_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every question is routed, and how many facts of its owner lie in each tier that it may read."""
    held = facts(spark, sf_dir)
    tiers = held.select("owner", hierarchical.tier_of(F.col("status"), F.col("assigned")).alias("tier"), (F.col("status") == "active").alias("live"))
    tiers = tiers.groupBy("owner").agg(*(F.count_if((F.col("tier") == t) & F.col("live")).alias(f"{t}_live") for t in (*hierarchical.TIERS, "quarantine")), F.count_if((F.col("tier") == "cold") & ~F.col("live")).alias("past"))
    asked = hierarchical.routed(hybrid.planned(plans.requests(spark, sf_dir)))
    n = lambda c: F.coalesce(c, F.lit(0))
    return asked.join(tiers, "owner", "left").select(
        "request_id", "policy", *(F.col(f"tiers.{t}").alias(f"{t}_budget") for t in hierarchical.TIERS), "summaries", n("hot_live").alias("hot"), n("warm_live").alias("warm"),
        (n("cold_live") + F.when(F.col("mode") == "current", 0).otherwise(n("past"))).alias("cold"), n("quarantine_live").alias("quarantine"),
    )


_INTENT_LEAST = " ".join(f"WHEN '{k}' THEN {v[6]}" for k, v in cues.BUDGETS.items())
TIERED = f"""{plans.FACTS}, {plans.PLANS}, v_tier AS (
  SELECT *, CASE WHEN id % 23 = 0 THEN 'quarantine' WHEN status <> 'active' THEN 'cold' WHEN id % 17 = 0 THEN 'warm' WHEN age_days < 200 THEN 'hot' WHEN age_days < 500 THEN 'warm' ELSE 'cold' END AS tier, coalesce(key, kind) AS fkey,
    round(0.5 * importance + 0.3 * confidence + 0.2 * pow(0.5, age_days / CASE kind WHEN 'identity' THEN 730.0 WHEN 'project' THEN 120.0 WHEN 'explicit' THEN 365.0 ELSE 240.0 END), 6) AS utility FROM v_fact
), v_route AS (SELECT *, CASE WHEN intent = 'external' THEN 'disabled' WHEN mode <> 'current' OR intent IN ('timeline', 'temporal', 'enumerative') THEN 'eager' ELSE 'fallback' END AS policy, greatest(8, least(256, budget)) AS lanes, CASE intent {_INTENT_LEAST} END AS least FROM v_plan),
v_lane AS (SELECT *, greatest(1, CASE policy WHEN 'eager' THEN CAST(floor(lanes * 0.25) AS BIGINT) ELSE CAST(floor(lanes * (1.0::DOUBLE / 3)) AS BIGINT) END) AS hot0, greatest(1, CASE policy WHEN 'eager' THEN CAST(floor(lanes * 0.3) AS BIGINT) ELSE least(16, CAST(ceil(lanes * (1.0::DOUBLE / 3)) AS BIGINT)) END) AS cold0,
  greatest(4, least(24, CAST(ceil(lanes / 4.0) AS BIGINT))) AS summaries FROM v_route),
v_asked AS (SELECT *, CASE WHEN policy = 'disabled' THEN 0 ELSE hot0 END AS hot_budget, CASE WHEN policy = 'disabled' THEN 0 ELSE greatest(1, lanes - hot0 - CASE policy WHEN 'eager' THEN cold0 ELSE 0 END) END AS warm_budget, CASE WHEN policy = 'disabled' THEN 0 ELSE cold0 END AS cold_budget FROM v_lane)"""

TIER_ROUTES = f"""WITH {TIERED} SELECT request_id, policy, CAST(hot_budget AS BIGINT) AS hot_budget, CAST(warm_budget AS BIGINT) AS warm_budget, CAST(cold_budget AS BIGINT) AS cold_budget, CAST(summaries AS BIGINT) AS summaries,
  (SELECT count(*) FROM v_tier t WHERE t.owner = a.owner AND tier = 'hot') AS hot, (SELECT count(*) FROM v_tier t WHERE t.owner = a.owner AND tier = 'warm') AS warm,
  (SELECT count(*) FROM v_tier t WHERE t.owner = a.owner AND tier = 'cold' AND (status = 'active' OR a.mode <> 'current')) AS cold, (SELECT count(*) FROM v_tier t WHERE t.owner = a.owner AND tier = 'quarantine' AND status = 'active') AS quarantine FROM v_asked a"""


def _evidence(key: str, concepts: str, intent: str) -> str:
    return f"""CASE WHEN {intent} = 'enumerative' THEN 0.72 WHEN list_contains({concepts}, {key}) THEN 1.0 WHEN list_contains({concepts}, 'preference.any') AND len(list_filter({concepts}, lambda x: x LIKE 'preference.%' AND x <> 'preference.any')) = 0 AND {key} LIKE 'preference.%' THEN 0.65
      WHEN len(list_filter({concepts}, lambda x: starts_with({key}, x || '.') OR starts_with(x, {key} || '.'))) > 0 THEN 0.86 ELSE 0.0 END"""


def _combined(*columns: str) -> str:
    values = ", ".join(f"greatest(0.0, coalesce({c}, 0.0))" for c in columns)
    return f"(WITH z AS (SELECT list_reverse_sort(list_concat([{values}], [0.0, 0.0])) AS l) SELECT round(l[1] + 0.16 * (1 - l[1]) * l[2] + 0.08 * (1 - l[1]) * l[3], 9) FROM z)"


def _bm(name: str, live: str) -> str:
    """BM25 of live rows (request_id, owner, id, tokens) of each request."""
    return f"""{name}_p AS (SELECT request_id, id, token, count(*) AS tf, any_value(len(tokens)) AS length FROM (SELECT request_id, id, tokens, unnest(tokens) AS token FROM {live}) GROUP BY ALL),
{name}_d AS (SELECT request_id, token, count(*) AS df FROM {name}_p GROUP BY ALL), {name}_n AS (SELECT request_id, count(*) AS n, avg(len(tokens)) AS mean FROM {live} GROUP BY ALL),
{name}_l AS (SELECT request_id, id, round(1 - exp(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean)))), 9) AS lexical FROM q_term JOIN {name}_p USING (request_id, token) JOIN {name}_d USING (request_id, token) JOIN {name}_n USING (request_id) GROUP BY request_id, id)"""


def _stage(name: str, asked: str, cold: str) -> str:
    """The ranking of the requests of a table; cold: which of them read the cold tier."""
    budget = "CASE tier WHEN 'hot' THEN hot_budget WHEN 'warm' THEN warm_budget ELSE cold_budget END"
    return f"""{name}_c AS (SELECT a.request_id, a.lanes, a.least, a.intent, a.tags AS asked, a.hot_budget, a.warm_budget, a.cold_budget, f.id, f.tier, f.fkey, f.confidence, f.utility, f.importance, lexical, semantic, {_evidence("f.fkey", "a.tags", "a.intent")} AS structured
  FROM {asked} a JOIN v_tier f ON f.owner = a.owner AND f.tier <> 'quarantine' AND (a.mode <> 'current' OR f.status = 'active') AND (f.tier <> 'cold' OR {cold}) LEFT JOIN f_l l ON l.request_id = a.request_id AND l.id = f.id AND lexical >= 0.12 LEFT JOIN f_s s ON s.request_id = a.request_id AND s.id = f.id AND semantic >= 0.08),
{name}_t AS (SELECT *, CASE WHEN lexical IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, tier, lexical IS NULL ORDER BY lexical DESC, id) END AS l0, CASE WHEN semantic IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, tier, semantic IS NULL ORDER BY semantic DESC, id) END AS s0,
  CASE WHEN structured > 0 AND (len(asked) > 0 OR intent = 'enumerative') THEN row_number() OVER (PARTITION BY request_id, tier, structured > 0 ORDER BY utility DESC, id) END AS t0 FROM {name}_c),
{name}_k AS (SELECT * REPLACE (CASE WHEN l0 <= {budget} THEN lexical END AS lexical, CASE WHEN s0 <= {budget} THEN semantic END AS semantic, CASE WHEN t0 <= {budget} THEN structured END AS structured), CAST(CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END AS INTEGER) AS lane FROM {name}_t),
{name}_r AS (SELECT *, CASE WHEN lexical IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, lexical IS NULL ORDER BY lexical DESC, id) END AS l1, CASE WHEN semantic IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, semantic IS NULL ORDER BY semantic DESC, id) END AS s1,
  CASE WHEN structured IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, structured IS NULL ORDER BY lane, utility DESC, id) END AS t1 FROM {name}_k),
{name}_e AS (SELECT * REPLACE (CASE WHEN l1 <= lanes THEN l1 END AS l1, CASE WHEN s1 <= lanes THEN s1 END AS s1, CASE WHEN t1 <= lanes THEN t1 END AS t1) FROM {name}_r),
{name}_v AS (SELECT e.*, {_combined("CASE WHEN l1 IS NOT NULL THEN lexical END", "CASE WHEN s1 IS NOT NULL THEN semantic END", "CASE WHEN t1 IS NOT NULL THEN structured END")} AS direct, led.evidence AS led, led.place AS led_place FROM {name}_e e LEFT JOIN led USING (request_id, id)),
{name}_w AS (SELECT *, CASE WHEN led IS NOT NULL AND direct >= least * 0.5 THEN row_number() OVER (PARTITION BY request_id, led IS NOT NULL AND direct >= least * 0.5 ORDER BY led_place, id) END AS m0 FROM {name}_v),
{name}_f AS (SELECT *, CASE WHEN m0 <= lanes THEN m0 END AS m1, coalesce(1.0 / (60.0 + l1), 0) + coalesce(1.0 / (60.0 + s1), 0) + coalesce(1.0 / (60.0 + t1), 0) + coalesce(CASE WHEN m0 <= lanes THEN 1.0 / (60.0 + m0) END, 0) AS f FROM {name}_w),
{name}_g AS (SELECT *, round(least(1.0, direct + 0.25 * CASE WHEN m1 IS NOT NULL THEN led ELSE 0.0 END * (1 - direct)), 6) AS evidence, f / max(f) OVER (PARTITION BY request_id) AS relative FROM {name}_f WHERE f > 0),
{name}_h AS (SELECT *, round(least(1.0, 0.88 * evidence + 0.06 * relative * evidence + 0.02 * (confidence + utility + importance)), 6) AS score FROM {name}_g WHERE intent = 'enumerative' OR len(asked) = 0 OR {_evidence("fkey", "asked", "intent")} > 0),
{name}_i AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, evidence DESC, id) AS INTEGER) AS rank FROM {name}_h),
{name} AS (SELECT *, max(CASE WHEN rank = 1 THEN evidence END) OVER (PARTITION BY request_id) >= least AND evidence >= least AS eligible FROM {name}_i WHERE rank <= lanes)"""


RECALL_HIERARCHICAL = f"""WITH RECURSIVE {TIERED}, q_ask AS (SELECT * FROM v_asked WHERE policy <> 'disabled'),
q_term AS (SELECT request_id, owner, unnest(list_distinct({plans._tokens_sql("said")})) AS token FROM q_ask), q_dim AS {plans._dims_sql("q_ask", "request_id, owner")},
f_live AS (SELECT request_id, a.owner, id, tokens FROM q_ask a JOIN v_tier f ON f.owner = a.owner AND f.tier <> 'quarantine' AND (a.mode <> 'current' OR f.status = 'active')), {_bm("f", "f_live")},
f_dim AS {plans._dims_sql("v_tier", "owner, id")}, f_s AS (SELECT request_id, id, round(sum(q_dim.weight * f_dim.weight), 9) AS semantic FROM q_dim JOIN f_dim USING (owner, dim) GROUP BY ALL),
s_doc0 AS (SELECT owner, owner || '/' || kind AS id, kind || '：' || string_agg(content, '；' ORDER BY id) AS said, list(id) AS facts FROM v_tier WHERE status = 'active' GROUP BY owner, kind),
s_doc AS (SELECT *, {plans._concepts_sql("said")} AS tags, {plans._tokens_sql("said")} AS tokens FROM s_doc0),
s_live AS (SELECT request_id, a.owner, d.id, d.tokens FROM q_ask a JOIN s_doc d USING (owner)), {_bm("s", "s_live")}, s_dim AS {plans._dims_sql("s_doc", "owner, id")},
s_s AS (SELECT request_id, id, round(sum(q_dim.weight * s_dim.weight), 9) AS semantic FROM q_dim JOIN s_dim USING (owner, dim) GROUP BY ALL),
s_cut AS (SELECT coalesce(l.request_id, s.request_id) AS request_id, coalesce(l.id, s.id) AS id, lexical, semantic FROM (SELECT * FROM s_l WHERE lexical >= 0.12) l FULL JOIN (SELECT * FROM s_s WHERE semantic >= 0.08) s ON l.request_id = s.request_id AND l.id = s.id),
s_ev AS (SELECT request_id, id, {_combined("lexical", "semantic")} AS evidence FROM s_cut),
s_top AS (SELECT e.*, row_number() OVER (PARTITION BY request_id ORDER BY evidence DESC, e.id) AS place, summaries FROM s_ev e JOIN q_ask USING (request_id) WHERE evidence >= 0.28),
led AS (SELECT request_id, f.id, arg_max(evidence, (evidence, -place)) AS evidence, arg_max(place, (evidence, -place)) AS place FROM s_top t JOIN (SELECT id AS sid, unnest(facts) AS id FROM s_doc) f ON f.sid = t.id WHERE place <= summaries GROUP BY ALL),
{_stage("one", "q_ask", "a.policy = 'eager'")},
good AS (SELECT request_id, list(DISTINCT fkey) AS keys FROM one WHERE eligible GROUP BY ALL),
waits AS (SELECT a.* FROM q_ask a LEFT JOIN good USING (request_id) WHERE policy = 'fallback' AND (keys IS NULL OR (intent = 'multi-fact' AND len(list_filter(tags, lambda c: len(list_filter(keys, lambda k: c = k OR (c = 'preference.any' AND k LIKE 'preference.%') OR starts_with(k, c || '.') OR starts_with(c, k || '.'))) = 0)) > 0))),
{_stage("two", "waits", "true")},
final AS (SELECT *, 1 AS stage FROM one WHERE request_id NOT IN (SELECT request_id FROM waits) UNION ALL SELECT *, 2 FROM two)
SELECT request_id, id, tier, rank, round(score, 5) AS score, round(evidence, 5) AS evidence, array_to_string(list_filter([CASE WHEN l1 IS NOT NULL THEN 'lexical' END, CASE WHEN s1 IS NOT NULL THEN 'semantic' END, CASE WHEN t1 IS NOT NULL THEN 'structured' END, CASE WHEN m1 IS NOT NULL THEN 'summary' END], lambda x: x IS NOT NULL), ',') AS routes, stage
FROM final WHERE eligible"""

QUERIES = {f.__name__: f for f in (recall_hierarchical, tier_routes)}
ORACLES = {"recall_hierarchical": RECALL_HIERARCHICAL, "tier_routes": TIER_ROUTES}
