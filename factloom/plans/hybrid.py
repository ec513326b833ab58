"""Queries on hybrid and adaptive recall over the facts that messages state: every customer asks one question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import cues, text
from factloom.functions.hashing import hashed_vector
from factloom.operators import extraction, hybrid, tables
from factloom.plans import messages, views

#: What customers ask, by their key: intents, routes, an owner without facts of the kind, questions for the world, and none.
QUESTIONS = (
    "What do you know about my music preferences?", "我叫什么名字", "Which city do I live in?", "总结我的偏好", "What is the weather today?", "Which quantum paper won?", "我以前住在哪里", "the door code",
    "我有什么过敏，以及我的宠物叫什么", "We talked about the door code", "My name is not Kai, actually?", "recap everything about me", None, "URGENT hiking on weekends",
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all messages: one of each owner and content, with its messages and the place of the first as id; of a key with one value the newest is
    active, and each but the first supersedes the one before."""
    found = extraction.normalised(extraction.candidates(messages.messages(spark, sf_dir), "conv", "turn", "role", "text"))
    rows = found.groupBy(F.col("conv").alias("owner"), "content", "kind", "key", "cardinality").agg(
        F.min(F.col("turn") * 10 + F.col("place")).alias("id"), F.max("turn").alias("updated_at"), F.collect_set("turn").alias("sources"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence")
    )
    single = (F.col("cardinality") == "single") & F.col("key").isNotNull()
    versions = Window.partitionBy("owner", "key", "cardinality").orderBy("updated_at", "id")
    return rows.withColumns(
        {
            "status": F.when(single & F.lead("id").over(versions).isNotNull(), "superseded").otherwise("active"), "supersedes": F.when(single, F.lag("id").over(versions)),
            "age_days": (F.col("updated_at") % 900).cast("double"), "uses": F.col("id") % 5,
        }
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % len(QUESTIONS)
    asked = F.coalesce(*(F.when(k == i, F.lit(q)) for i, q in enumerate(QUESTIONS) if q is not None))
    return views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("owner"), asked.alias("text"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = hybrid.planned(requests(spark, sf_dir))
    return asked, hybrid.recalled(asked, hybrid.index(facts(spark, sf_dir)))


def recall_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is planned for every question."""
    plan = hybrid.planned(requests(spark, sf_dir))
    return plan.select("request_id", "intent", "mode", "broad", F.array_join("concepts", ",").alias("concepts"), F.array_join("routes", ",").alias("routes"), "budget", "window", F.array_join("parts", "|").alias("parts"))


def recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ranking of every question over its owner's facts, by all routes."""
    return _ranked(spark, sf_dir)[1].select("request_id", "id", "rank", F.round("score", 5).alias("score"), F.array_join("routes", ",").alias("routes"), F.round("lexical", 5).alias("lexical"), F.round("semantic", 5).alias("semantic"), F.round("structured", 5).alias("structured"))


def recall_fixed(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Every fact's uses after the five best facts of each question were handed out."""
    held = tables.keyed(facts(spark, sf_dir), "facts-used")
    asked = hybrid.planned(requests(spark, sf_dir))
    top = hybrid.recalled(asked, hybrid.index(held)).where(F.col("rank") <= k)
    return hybrid.used(held, top).select("owner", "id", "uses")


def recall_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected for every question, and why selection ended; questions without a good answer say so."""
    asked, ranked = _ranked(spark, sf_dir)
    return hybrid.adaptive(asked, ranked).select("request_id", "place", "id", F.round("score", 5).alias("score"), "batches", "evaluated", "stopped")


def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed embedding of every fact, concepts included: the number of its dimensions, the first one, the largest weight, and the sum of absolute weights by place."""
    rows = facts(spark, sf_dir).select("owner", "id", hashed_vector("content", hybrid.DIMS, cues.concepts(F.col("content"))).alias("dims"))
    total = F.aggregate("dims", F.lit(0.0), lambda a, d: a + F.abs(d["weight"]) * (d["dim"] + 1))
    own = F.struct(F.size("dims").cast("long").alias("dims"), F.array_min("dims.dim").alias("first_dim"), F.round(total, 5).alias("total"), F.round(F.array_max("dims.weight"), 6).alias("largest"))
    return rows.select("owner", "id", F.inline(F.when(F.size("dims") > 0, F.array(own))))


def _lit(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _concepts_sql(column: str) -> str:
    tags = ", ".join(f"CASE WHEN regexp_matches(lower({column}), {_lit([p])}) THEN {_lit([n])} END" for n, p in cues.CONCEPTS.items())
    return f"list_filter([{tags}], lambda x: x IS NOT NULL)"


def _tokens_sql(column: str) -> str:
    han = f"regexp_replace({column}, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')"
    return f"""list_concat(list_concat(list_transform(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda x: 'w:' || x), list_transform(range(1, length({han}) + 1), lambda i: 'c:' || substring({han}, i, 1))),
      list_transform(range(1, length({han})), lambda i: 'b:' || substring({han}, i, 2)))"""


def _dims_sql(source: str, keys: str) -> str:
    """(keys, dim, weight) of a table with keys, said and tags."""
    return f"""(WITH t AS (SELECT {keys}, unnest(list_concat(list_concat({_tokens_sql("said")},
      flatten(list_transform(list_filter(regexp_extract_all(lower(said), '[a-z0-9]+'), lambda w: length(w) >= 4), lambda w: list_transform(range(1, length(w) - 1), lambda i: 'g:' || substring(w, i, 3))))),
      flatten(list_transform(tags, lambda s: list_transform(range(5), lambda i: 's:' || s))))) AS term FROM {source}),
    h AS (SELECT {keys}, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(term, ''), lambda x: CAST(unicode(x) AS UBIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS hash FROM t),
    w AS (SELECT {keys}, CAST(hash % {hybrid.DIMS} AS INTEGER) AS dim, sum(CASE WHEN hash & 2147483648 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY ALL HAVING s <> 0)
    SELECT {keys}, dim, s / sqrt(sum(s * s) OVER (PARTITION BY {keys})) AS weight FROM w)"""


FACTS = f"""{messages.STATED}, v_fact0 AS (
  SELECT conv AS owner, content, kind, key, cardinality, min(turn * 10 + place) AS id, max(turn) AS updated_at, list(DISTINCT turn) AS sources, max(importance) AS importance, max(confidence) AS confidence FROM v_stated GROUP BY ALL
), v_fact AS (
  SELECT *, CASE WHEN cardinality = 'single' AND key IS NOT NULL AND lead(id) OVER v IS NOT NULL THEN 'superseded' ELSE 'active' END AS status, CASE WHEN cardinality = 'single' AND key IS NOT NULL THEN lag(id) OVER v END AS supersedes,
    CAST(updated_at % 900 AS DOUBLE) AS age_days, id % 5 AS uses, content AS said, {_concepts_sql("content")} AS tags, {_tokens_sql("content")} AS tokens
  FROM v_fact0 WINDOW v AS (PARTITION BY owner, key, cardinality ORDER BY updated_at, id)
)"""

_BROAD = "|".join(text.BROAD_PATTERNS).replace("'", "''")
_INTENTS = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in cues.BUDGETS.items())
PLANS = f"""v_ask AS (SELECT c_custkey AS request_id, c_custkey AS owner, [{_lit([q or "" for q in QUESTIONS])}][c_custkey % {len(QUESTIONS)} + 1] AS said FROM customer),
v_cue AS (SELECT *, trim(lower(said)) AS low, {_concepts_sql("said")} AS tags, regexp_matches(lower(said), '{_BROAD}') AS broad FROM v_ask),
v_mode AS (SELECT *, regexp_matches(low, '{cues.TIMELINE}') AS timeline, regexp_matches(low, '{cues.PAST}') AS past, regexp_matches(low, '{cues.PERSONAL}') AS personal FROM v_cue),
v_intent AS (SELECT *, CASE WHEN timeline THEN 'all' WHEN past THEN 'historical' ELSE 'current' END AS mode,
  CASE WHEN low = '' OR (regexp_matches(low, '{cues.EXTERNAL}') AND NOT personal AND len(tags) = 0 AND NOT broad AND NOT past) THEN 'external' WHEN timeline THEN 'timeline' WHEN broad AND len(tags) <= 1 THEN 'enumerative'
    WHEN past THEN 'temporal' WHEN len(tags) > 1 OR regexp_matches(low, '{cues.SEVERAL}') THEN 'multi-fact' ELSE 'specific' END AS intent FROM v_mode),
v_plan AS (SELECT *, CASE intent {_INTENTS} END AS budget, least(100, 2 * CASE intent {_INTENTS} END) AS win,
  CASE WHEN intent = 'external' THEN [] ELSE list_filter(['lexical', 'semantic', CASE WHEN len(tags) > 0 OR intent = 'enumerative' THEN 'structured' END, CASE WHEN intent IN ('temporal', 'timeline') THEN 'temporal' END,
    CASE WHEN regexp_matches(low, '{cues.CORRECTION}') THEN 'correction' END, CASE WHEN regexp_matches(low, '{cues.EPISODE}') THEN 'episode' END], lambda x: x IS NOT NULL) END AS routes,
  CASE WHEN intent = 'multi-fact' THEN list_prepend(low, list_filter(list_transform(regexp_split_to_array(low, '{cues.SEPARATOR}'), lambda x: trim(x)), lambda x: length(x) >= 2 AND (personal OR regexp_matches(x, '{cues.PERSONAL}')))[1:3]) ELSE [low] END AS parts
  FROM v_intent)"""

RECALL_PLANS = f"""WITH {PLANS} SELECT request_id, intent, mode, broad, array_to_string(tags, ',') AS concepts, array_to_string(routes, ',') AS routes, budget, win AS "window", array_to_string(parts, '|') AS parts FROM v_plan"""

RANKED = f"""{FACTS}, {PLANS}, v_live AS (SELECT p.*, f.id, f.content, f.kind, f.importance, f.confidence, f.status, f.supersedes, f.age_days, f.sources, f.tags AS f_tags, f.tokens FROM v_plan p JOIN v_fact f USING (owner) WHERE intent <> 'external' AND (mode <> 'current' OR status = 'active')),
term AS (SELECT request_id, owner, part, unnest(list_distinct({_tokens_sql("part_said")})) AS token FROM (SELECT request_id, owner, unnest(parts) AS part_said, generate_subscripts(parts, 1) AS part FROM v_plan WHERE intent <> 'external')),
post AS (SELECT request_id, id, win, token, count(*) AS tf, any_value(len(tokens)) AS length FROM (SELECT request_id, id, win, tokens, unnest(tokens) AS token FROM v_live) GROUP BY ALL),
dfs AS (SELECT request_id, token, count(*) AS df FROM post GROUP BY ALL), st AS (SELECT request_id, count(*) AS n, avg(len(tokens)) AS mean FROM v_live GROUP BY ALL),
bm AS (SELECT request_id, part, id, any_value(win) AS win, round(1 - exp(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean)))), 9) AS s FROM term JOIN post USING (request_id, token) JOIN dfs USING (request_id, token) JOIN st USING (request_id) GROUP BY request_id, part, id),
lex AS (SELECT request_id, id, max(s) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY request_id, part ORDER BY s DESC, id) AS k FROM bm) WHERE k <= least(400, 4 * win) GROUP BY ALL),
act AS (SELECT owner, id, unnest(list_distinct(tokens)) AS token FROM v_fact WHERE status = 'active'), actn AS (SELECT owner, token, count(*) AS n FROM act GROUP BY ALL),
strong AS (SELECT DISTINCT request_id, id FROM term JOIN post USING (request_id, token) WHERE part = 1 AND token NOT LIKE 'c:%'),
hit AS (SELECT DISTINCT request_id, id FROM term JOIN act USING (owner, token) JOIN actn USING (owner, token) WHERE part = 1 AND token NOT LIKE 'c:%' AND n <= 500),
qd AS {_dims_sql("v_plan", "request_id, owner")}, fd AS {_dims_sql("v_fact", "owner, id")},
sem AS (SELECT request_id, id, round(sum(qd.weight * fd.weight), 9) AS semantic FROM qd JOIN fd USING (owner, dim) GROUP BY ALL),
seed AS (SELECT request_id, id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY lexical DESC, id) AS k FROM lex WHERE lexical >= 0.08) WHERE k <= 12 UNION SELECT request_id, id FROM hit),
msg AS (SELECT owner, id, unnest(sources) AS message FROM v_fact WHERE status = 'active'),
nb AS (SELECT request_id, id FROM (SELECT DISTINCT s.request_id, b.id FROM seed s JOIN v_plan p USING (request_id) JOIN msg a ON a.owner = p.owner AND a.id = s.id JOIN msg b ON b.owner = a.owner AND b.message = a.message WHERE list_contains(p.routes, 'episode'))
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY id) <= 60),
feat AS (SELECT v.*, coalesce(lexical, 0.0) AS lexical, least(1.0, greatest(0.0, coalesce(semantic, 0.0))) AS semantic, strong.id IS NOT NULL AS strong, hit.id IS NOT NULL AS hit, nb.id IS NOT NULL AS nb, len(v.tags) > 0 AS aimed,
  CASE WHEN len(v.tags) > 0 THEN round(list_sum(list_transform(v.tags, lambda x: CASE WHEN list_contains(v.f_tags, x) THEN CASE WHEN x = 'preference.any' THEN 0.2 ELSE 1.0 END ELSE 0.0 END)) / list_sum(list_transform(v.tags, lambda x: CASE WHEN x = 'preference.any' THEN 0.2 ELSE 1.0 END)), 9) ELSE 0.0 END AS coverage
  FROM v_live v LEFT JOIN lex ON lex.request_id = v.request_id AND lex.id = v.id LEFT JOIN sem ON sem.request_id = v.request_id AND sem.id = v.id LEFT JOIN strong ON strong.request_id = v.request_id AND strong.id = v.id
  LEFT JOIN hit ON hit.request_id = v.request_id AND hit.id = v.id LEFT JOIN nb ON nb.request_id = v.request_id AND nb.id = v.id),
scr AS (SELECT *, CAST(CASE WHEN aimed THEN coverage WHEN broad THEN round(importance * 0.6 + confidence * 0.4, 9) WHEN hit THEN 0.45 + importance * 0.1 ELSE 0.0 END AS DOUBLE) AS structured,
  CASE mode WHEN 'historical' THEN CASE status WHEN 'superseded' THEN 1.0 ELSE 0.2 END WHEN 'current' THEN 1.0 ELSE 0.7 END AS temporal, round(pow(0.5, age_days / CASE kind WHEN 'identity' THEN 730.0 WHEN 'project' THEN 120.0 WHEN 'explicit' THEN 365.0 ELSE 240.0 END), 2) AS recency,
  lexical >= 0.08 AND strong AND (NOT aimed OR coverage > 0) AS in_l, semantic >= 0.2 AND ((aimed AND coverage > 0) OR (NOT aimed AND (strong OR semantic >= 0.34))) AS in_s, CASE WHEN aimed THEN coverage > 0 ELSE broad OR hit END AS in_t, nb AND list_contains(routes, 'episode') AS in_e FROM feat),
route AS (SELECT *, unnest(['lexical', 'semantic', 'structured', 'temporal', 'correction', 'episode']) AS route, unnest([CASE WHEN in_l THEN lexical END, CASE WHEN in_s THEN semantic END, CASE WHEN in_t THEN structured END, CASE WHEN temporal > 0 THEN temporal END,
  CASE WHEN status = 'superseded' OR supersedes IS NOT NULL THEN round(CASE WHEN supersedes IS NOT NULL THEN 0.9 ELSE 0.75 END * 0.7 + lexical * 0.2 + semantic * 0.1, 9) END, CASE WHEN in_e THEN round(0.5 + lexical * 0.3 + (importance + confidence) / 2 * 0.2, 9) END]) AS s FROM scr WHERE in_l OR in_s OR in_t OR in_e),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id, route ORDER BY s DESC, CASE WHEN route = 'temporal' THEN age_days ELSE 0 END, content, id) AS place FROM route WHERE s IS NOT NULL AND list_contains(routes, route)),
fused AS (SELECT request_id, id, content, importance, confidence, temporal, recency, lexical, semantic, structured, sum(1.0 / (60.0 + place)) AS f, list_sort(list(route)) AS found FROM placed WHERE place <= win GROUP BY ALL),
live AS (SELECT request_id, count(DISTINCT route) AS of_routes FROM placed WHERE place <= win GROUP BY ALL),
scored AS (SELECT *, round(least(1.0, 0.78 * f / max(f) OVER (PARTITION BY request_id) + 0.09 * len(found) / of_routes + 0.06 * (0.45 * importance + 0.55 * confidence) + 0.05 * temporal + 0.02 * recency), 6) AS score FROM fused JOIN live USING (request_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, len(found) DESC, content, id) AS INTEGER) AS rank FROM scored WHERE score >= 0.12)"""

RECALL_HYBRID = f"""WITH RECURSIVE {RANKED} SELECT request_id, id, rank, round(score, 5) AS score, array_to_string(found, ',') AS routes, round(lexical, 5) AS lexical, round(semantic, 5) AS semantic, round(structured, 5) AS structured FROM ranked"""
RECALL_FIXED = f"""WITH RECURSIVE {RANKED}, u AS (SELECT id, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY id) SELECT owner, id, uses + coalesce(n, 0) AS uses FROM v_fact LEFT JOIN u USING (id)"""
HASHED_EMBEDDINGS = f"""WITH {FACTS}, d AS {_dims_sql("v_fact", "owner, id")} SELECT owner, id, count(*) AS dims, min(dim) AS first_dim, round(sum(abs(weight) * (dim + 1)), 5) AS total, round(max(weight), 6) AS largest FROM d GROUP BY owner, id"""

QUERIES = {f.__name__: f for f in (recall_plans, recall_hybrid, recall_fixed, recall_adaptive, hashed_embeddings)}
ORACLES = {"recall_plans": RECALL_PLANS, "recall_hybrid": RECALL_HYBRID, "recall_fixed": RECALL_FIXED, "hashed_embeddings": HASHED_EMBEDDINGS}
