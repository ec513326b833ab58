"""Queries on facts over time: validity, versions, feedback, tiers, buckets, duplicates, safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import audits, maintenance, temporal, versions
from factloom.plans import views

AT, LOW, HIGH = "1997-01-01", "1996-06-01", "1996-09-01"


def _day(d: str):
    return F.to_timestamp_ntz(F.lit(d + " 00:00:00"))


FACT = ("owner", "fact_id", "value", "valid_from", "valid_to", "status")


def temporal_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where("status = 'active'").select(*FACT)


def temporal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where(temporal.valid_at(_day(AT))).select(*FACT)


def temporal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where(temporal.overlaps(_day(LOW), _day(HIGH))).select(*FACT)


_FACT = ", ".join(FACT)
TEMPORAL_CURRENT = f"WITH {views.FACTS} SELECT {_FACT} FROM v_fact WHERE status = 'active'"
TEMPORAL_ASOF = f"WITH {views.FACTS} SELECT {_FACT} FROM v_fact WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')"
TEMPORAL_OVERLAP = f"WITH {views.FACTS} SELECT {_FACT} FROM v_fact WHERE valid_from < TIMESTAMP '{HIGH}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{LOW}')"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.numbered_versions(views.facts(spark, sf_dir).select("owner", "fact_id", "value", "valid_from", "importance"), "owner", "valid_from", "fact_id")


def version_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("owner", "fact_id", "version", "recorded_at", "closed_at")


VERSION_CLOSE = f"""WITH {views.FACTS}
SELECT owner, fact_id, CAST(row_number() OVER w AS INTEGER) AS version, valid_from AS recorded_at, lead(valid_from) OVER w AS closed_at
FROM v_fact WINDOW w AS (PARTITION BY owner ORDER BY valid_from, fact_id)"""


def version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_as_of(_versions(spark, sf_dir), "owner", _day(AT)).select("owner", "fact_id", "version", "value")


VERSION_ASOF = f"""WITH {views.FACTS},
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner ORDER BY valid_from, fact_id) AS INTEGER) AS version FROM v_fact)
SELECT owner, fact_id, version, value FROM n WHERE valid_from <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY valid_from DESC, version DESC) = 1"""


def change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.facts(spark, sf_dir).select(
        "owner", "fact_id", "valid_from",
        F.when(F.col("fact_id") % 7 == 0, "conflicted").when(F.col("fact_id") % 5 == 0, "suppressed").otherwise("active").alias("state"),
        F.when(F.col("fact_id") % 3 == 0, F.lower("value")).otherwise(F.col("value")).alias("value"), F.round("importance", 2).alias("strength"),
    )
    return versions.change_class(rows, "owner", "valid_from", "fact_id", "state", "value").select("owner", "fact_id", "state", "operation")


CHANGE_CLASSIFY = f"""WITH {views.FACTS},
r AS (
  SELECT owner, fact_id, valid_from, CASE WHEN fact_id % 7 = 0 THEN 'conflicted' WHEN fact_id % 5 = 0 THEN 'suppressed' ELSE 'active' END AS state,
    CASE WHEN fact_id % 3 = 0 THEN lower(value) ELSE value END AS value, round(importance, 2) AS strength FROM v_fact
), b AS (
  SELECT *, lag(state) OVER w AS ps, lag(value) OVER w AS pv, lag(strength) OVER w AS pt FROM r WINDOW w AS (PARTITION BY owner ORDER BY valid_from, fact_id)
)
SELECT owner, fact_id, state, CASE WHEN ps IS NULL THEN 'ADD' WHEN state = 'active' AND ps <> 'active' THEN 'RESTORE' WHEN state = 'conflicted' AND ps <> 'conflicted' THEN 'CONFLICT'
  WHEN state = 'suppressed' AND ps <> 'suppressed' THEN 'SUPPRESS' WHEN lower(value) <> lower(pv) THEN 'SUPERSEDE' WHEN value <> pv THEN 'REFINE'
  WHEN strength > pt THEN 'MERGE_EVIDENCE' ELSE 'NOOP' END AS operation FROM b"""


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of upserts and deletes for each customer and status, folded into the latest image."""
    o = views.read(spark, sf_dir, "orders")
    log = o.select(
        F.concat_ws(":", "o_custkey", "o_orderstatus").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 4 == 0, "delete").otherwise("upsert").alias("op"), F.col("o_orderkey").alias("value"),
    )
    return versions.replayed(log, "key", "seq").select("key", "value")


LOG_REPLAY = """WITH l AS (SELECT o_custkey || ':' || o_orderstatus AS key, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT key, value FROM l WHERE n = 1 AND value % 4 <> 0"""


def capture_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one role in a conversation as registrations of one identity."""
    return versions.revisions(views.episodes(spark, sf_dir), ["owner", "actor"], "turn", "episode_id", "content_hash").select("episode_id", "owner", "actor", "revision", "is_noop")


CAPTURE_REVISIONS = f"""WITH {views.EPISODES},
c AS (SELECT episode_id, owner, actor, turn, content_hash AS h FROM v_episode),
x AS (SELECT *, CASE WHEN lag(episode_id) OVER w IS NULL THEN 1 ELSE CAST(h <> lag(h) OVER w AS INT) END AS ch FROM c WINDOW w AS (PARTITION BY owner, actor ORDER BY turn, episode_id))
SELECT episode_id, owner, actor, CAST(sum(ch) OVER (PARTITION BY owner, actor ORDER BY turn, episode_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision, ch = 0 AS is_noop FROM x"""


def capacity_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintenance.within_capacity(views.facts(spark, sf_dir), ["owner"], 3, (F.col("status") == "active").desc(), F.desc("valid_from"), F.desc("fact_id"))
    return kept.select("owner", "fact_id", "status")


CAPACITY_PRUNE = f"""WITH {views.FACTS} SELECT owner, fact_id, status FROM v_fact
QUALIFY row_number() OVER (PARTITION BY owner ORDER BY status = 'active' DESC, valid_from DESC, fact_id DESC) <= 3"""


def feedback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.feedback_signals(views.feedback(spark, sf_dir))


FEEDBACK_SIGNALS = f"""WITH {views.FEEDBACK} SELECT fact_id, count(*) FILTER (outcome = 'adopted') AS adopted, count(*) FILTER (outcome = 'corrected') AS corrected,
  count(*) FILTER (outcome = 'denied') AS denied, count(*) AS accesses FROM v_feedback WHERE fact_id IS NOT NULL GROUP BY fact_id"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their utility: signals by fact id modulo 100, evidence by importance, age against a fixed day."""
    facts = views.facts(spark, sf_dir).withColumn("signal", F.col("fact_id") % 100)
    signals = maintenance.feedback_signals(views.feedback(spark, sf_dir)).withColumnRenamed("fact_id", "signal")
    rows = facts.join(signals, "signal", "left").na.fill(0, ["adopted", "corrected", "denied", "accesses"])
    rows = rows.withColumn("same", F.count("*").over(maintenance.Window.partitionBy("owner", "value")))
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.col("valid_from").cast("date")).cast("double")
    value = maintenance.utility(
        F.col("importance"), F.lit(0.5), F.col("adopted") / 100.0, F.col("accesses") / 1000.0, age, F.col("same") == 1, F.col("status") == "active", F.col("denied") / 100.0, F.col("corrected") / 100.0
    )
    return rows.withColumn("utility", F.round(value + 1e-9, 6))  # no score lies on the edge of rounding, where engines differ


_SCORED = f"""{views.FACTS}, {views.FEEDBACK},
sig AS (SELECT fact_id AS signal, count(*) FILTER (outcome = 'adopted') AS adopted, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'denied') AS denied, count(*) AS accesses FROM v_feedback WHERE fact_id IS NOT NULL GROUP BY fact_id),
j AS (SELECT f.*, coalesce(adopted, 0) / 100.0 AS ad, coalesce(corrected, 0) / 100.0 AS co, coalesce(denied, 0) / 100.0 AS de, coalesce(accesses, 0) / 1000.0 AS ac,
  count(*) OVER (PARTITION BY owner, value) AS same, date_diff('day', CAST(valid_from AS DATE), DATE '2000-01-01') AS age FROM v_fact f LEFT JOIN sig ON fact_id % 100 = signal),
sc AS (SELECT *, round(greatest(0.0, least(1.0, 0.3 * importance + 0.15 * 0.5 + 0.2 * least(1.0, 0.25 * ad + 0.1 * ac) + 0.15 * pow(0.5, greatest(age, 0) / 30.0) + 0.1 * CASE WHEN same = 1 THEN 1.0 ELSE 0.4 END
  + 0.1 * CASE WHEN status = 'active' THEN 1.0 ELSE 0.0 END - least(0.5, 0.2 * de + 0.1 * co))) + 1e-9, 6) AS utility FROM j)"""


def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("owner", "fact_id", "utility")


UTILITY_SCORE = f"WITH {_SCORED} SELECT owner, fact_id, utility FROM sc"


def tier_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumns({"protected": F.col("sensitivity") == "secret", "quarantined": F.col("fact_id") % 50 == 0})
    tiers = maintenance.assigned_tiers(rows, "owner", "fact_id", hot=1, warm=4, cold=3, hot_least=0.25, warm_least=0.15)
    return tiers.select("owner", "fact_id", "utility", "tier")


TIER_ASSIGN = f"""WITH {_SCORED},
a AS (SELECT owner, fact_id, utility, sensitivity = 'secret' AS prot, fact_id % 50 = 0 AS quar FROM sc),
h AS (SELECT *, NOT quar AND utility >= 0.25 AND row_number() OVER (PARTITION BY owner, NOT quar AND utility >= 0.25 ORDER BY utility DESC, fact_id) <= 1 AS hot FROM a),
w0 AS (SELECT *, NOT quar AND NOT hot AND (prot OR utility >= 0.15) AS w FROM h),
w1 AS (SELECT *, w AND (prot OR row_number() OVER (PARTITION BY owner, w ORDER BY prot DESC, utility DESC, fact_id) <= 4) AS warm FROM w0),
c0 AS (SELECT *, NOT quar AND NOT hot AND NOT warm AS c FROM w1),
c1 AS (SELECT *, c AND row_number() OVER (PARTITION BY owner, c ORDER BY utility DESC, fact_id) <= 3 AS cold FROM c0)
SELECT owner, fact_id, utility, CASE WHEN quar THEN 'quarantine' WHEN hot THEN 'hot' WHEN warm THEN 'warm' WHEN cold THEN 'cold' ELSE 'archive' END AS tier FROM c1"""


def feedback_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report (adopted, corrected, denied) with the latest retrieval of the same owner and fact before it: one
    pass over a window, no range join."""
    rows = views.feedback(spark, sf_dir)
    w = maintenance.Window.partitionBy("owner", "fact_id").orderBy("seen_at", "event_id").rowsBetween(maintenance.Window.unboundedPreceding, -1)
    shown = F.when(F.col("outcome").isin("retrieved", "injected"), F.col("event_id"))
    return rows.withColumn("retrieval_id", F.last(shown, True).over(w)).where(F.col("outcome").isin("adopted", "corrected", "denied")).select("event_id", "outcome", "retrieval_id")


FEEDBACK_ASOF = f"""WITH {views.FEEDBACK},
x AS (SELECT *, last_value(CASE WHEN outcome IN ('retrieved', 'injected') THEN event_id END IGNORE NULLS) OVER (PARTITION BY owner, fact_id ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS retrieval_id FROM v_feedback)
SELECT event_id, outcome, retrieval_id FROM x WHERE outcome IN ('adopted', 'corrected', 'denied')"""


def buckets_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {
        "session": F.col("owner"), "day": F.date_format("seen_at", "yyyy-MM-dd"), "topic": F.col("outcome"),
        "quarter": F.concat(F.year("seen_at"), F.lit("Q"), F.quarter("seen_at")), "entity": F.col("fact_id") % 10,
    }
    rows = views.feedback(spark, sf_dir)
    return maintenance.buckets(rows.withColumn("scope", F.col("owner") % 5), "scope", keys, "event_id", "fact_id")


BUCKETS_MULTI = f"""WITH {views.FEEDBACK},
k AS (
  SELECT owner % 5 AS scope, event_id, fact_id, unnest([{{'g': 'session', 'b': CAST(owner AS VARCHAR)}}, {{'g': 'day', 'b': strftime(seen_at, '%Y-%m-%d')}}, {{'g': 'topic', 'b': outcome}},
    {{'g': 'quarter', 'b': year(seen_at) || 'Q' || quarter(seen_at)}}, {{'g': 'entity', 'b': CAST(fact_id % 10 AS VARCHAR)}}]) AS k FROM v_feedback
)
SELECT scope, k.g AS granularity, k.b AS bucket, count(DISTINCT event_id) AS episodes, count(DISTINCT fact_id) AS facts FROM k WHERE k.b IS NOT NULL GROUP BY ALL"""


def summary_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.episodes(spark, sf_dir).withColumn("line", text.name_key("content"))
    return maintenance.summaries(rows, ["owner", "actor"], "episode_id", "line", "turn").select("owner", "actor", "summary", "texts", "rows", "since", "until")


SUMMARY_EXTRACT = rf"""WITH {views.EPISODES},
l AS (SELECT owner, actor, turn, episode_id, trim(regexp_replace(lower(coalesce(content, '')), '\s+', ' ', 'g')) AS line FROM v_episode),
d AS (SELECT owner, actor, line, min((turn, episode_id)) AS first, count(*) AS n, min(turn) AS since, max(turn) AS last FROM l GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY owner, actor ORDER BY first, line) AS place FROM d)
SELECT owner, actor, coalesce(string_agg(line, ' | ' ORDER BY place), '') AS summary, count(*) AS texts, CAST(sum(n) AS BIGINT) AS rows, min(since) AS since, max(last) AS until FROM p GROUP BY owner, actor"""


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").withColumn("key", F.sha2(text.comparable("text"), 256))
    groups = docs.groupBy("source", "key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return groups.where("copies > 1").select("source", "key", "copies", "first_id", "last_id")


EXACT_DUPLICATES = r"""WITH d AS (SELECT source, doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g')) AS key FROM documents)
SELECT source, key, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d GROUP BY ALL HAVING count(*) > 1"""


def rare_token_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one source that share a rarest token and half of their words."""
    return maintenance.rare_token_pairs(views.read(spark, sf_dir, "documents"), "doc_id", "source", text.word_tokens("text"), 0.5)


RARE_TOKEN_DUPLICATES = """WITH d AS (SELECT source, doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS toks FROM documents),
t AS (SELECT source, doc_id, unnest(toks) AS token FROM d),
f AS (SELECT source, token, count(*) AS df FROM t GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT t.*, row_number() OVER (PARTITION BY source, doc_id ORDER BY df, token) AS n FROM t JOIN f USING (source, token)),
p AS (SELECT DISTINCT x.source, x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.source = y.source AND x.token = y.token AND x.doc_id < y.doc_id AND x.n <= 3 AND y.n <= 3),
j AS (SELECT p.source, a, b, len(list_intersect(u.toks, v.toks)) AS c, len(u.toks) AS nu, len(v.toks) AS nv FROM p JOIN d u ON u.doc_id = a JOIN d v ON v.doc_id = b)
SELECT source, a, b, round(c / (nu + nv - c), 6) AS jaccard FROM j WHERE round(c / (nu + nv - c), 6) >= 0.5"""


def occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.episodes(spark, sf_dir)
    return versions.occurrence_survivors(rows, ["actor", "content_hash"], "turn", "episode_id").where("is_duplicate").select("episode_id", "survivor_id", "actor")


OCCURRENCE_DEDUP = f"""WITH {views.EPISODES},
s AS (SELECT *, first_value(episode_id) OVER (PARTITION BY actor, content_hash ORDER BY turn, episode_id) AS survivor_id FROM v_episode)
SELECT episode_id, survivor_id, actor FROM s WHERE episode_id <> survivor_id"""


def privacy_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").withColumn("p", text.privacy("text"))
    return docs.select("doc_id", F.col("p.sensitivity").alias("sensitivity"), F.col("p.share").alias("share"))


def safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "documents").select("doc_id", text.is_safe("text").alias("is_safe"))


_PERSONAL, _CREDENTIAL, _INJECTION = (p.replace("'", "''") for p in (text.PERSONAL, text.CREDENTIAL, text.INJECTION))
PRIVACY_CLASSIFY = f"""WITH p AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '{_PERSONAL}') AS x FROM documents)
SELECT doc_id, CASE WHEN x THEN 'private' ELSE 'normal' END AS sensitivity, CASE WHEN x THEN 'local-only' ELSE 'allow-remote' END AS share FROM p"""
SAFETY_GATE = f"""SELECT doc_id, trim(coalesce(text, '')) <> '' AND NOT regexp_matches(coalesce(text, ''), '{_CREDENTIAL}') AND NOT regexp_matches(coalesce(text, ''), '{_INJECTION}') AS is_safe FROM documents"""


def strictest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most sensitive and most restrictive class of each owner's facts."""
    g = views.facts(spark, sf_dir).groupBy("owner").agg(
        F.max(text.rank_in(text.SENSITIVITIES, "sensitivity")).alias("s"), F.max(text.rank_in(text.SHARES, "share")).alias("h"), F.count("*").alias("facts")
    )
    return g.select("owner", text.at_rank(text.SENSITIVITIES, F.col("s")).alias("sensitivity"), text.at_rank(text.SHARES, F.col("h")).alias("share"), "facts")


STRICTEST_POLICY = f"""WITH {views.FACTS},
g AS (SELECT owner, max(CASE sensitivity WHEN 'normal' THEN 1 WHEN 'private' THEN 2 ELSE 3 END) AS s, max(CASE share WHEN 'allow-remote' THEN 1 WHEN 'local-only' THEN 2 ELSE 3 END) AS h, count(*) AS facts FROM v_fact GROUP BY owner)
SELECT owner, ['normal', 'private', 'secret'][s] AS sensitivity, ['allow-remote', 'local-only', 'never'][h] AS share, facts FROM g"""


def eligibility_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each fact may not be recalled: the first failing check, with active direct evidence joined in."""
    evidence = views.links(spark, sf_dir).groupBy("fact_id").agg(F.count_if("active").alias("live"), F.max(F.when(F.col("active"), F.col("strength"))).alias("best"))
    rows = views.facts(spark, sf_dir).join(evidence, "fact_id", "left")
    checks = {
        "access-denied": F.col("share") == "never", "inactive": F.col("status") != "active", "source-unavailable": F.coalesce("live", F.lit(0)) == 0,
        "unverified": F.coalesce("best", F.lit(0.0)) < 0.5, "unknown-time": F.col("valid_from").isNull(),
    }
    judged = audits.waterfall(rows.select("owner", "fact_id", *(c for c in ("share", "status", "live", "best", "valid_from"))), {k: F.coalesce(v, F.lit(True)) for k, v in checks.items()})
    return judged.select("owner", "fact_id", F.coalesce("reason", F.lit("eligible")).alias("reason"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility_waterfall(spark, sf_dir).groupBy("reason").count().withColumnRenamed("count", "facts")


_WATERFALL = f"""{views.FACTS}, {views.LINKS},
e AS (SELECT fact_id, count(*) FILTER (active) AS live, max(strength) FILTER (active) AS best FROM v_link GROUP BY fact_id),
wf AS (SELECT owner, f.fact_id, CASE WHEN share = 'never' THEN 'access-denied' WHEN status <> 'active' THEN 'inactive' WHEN coalesce(live, 0) = 0 THEN 'source-unavailable'
  WHEN coalesce(best, 0) < 0.5 THEN 'unverified' WHEN valid_from IS NULL THEN 'unknown-time' ELSE 'eligible' END AS reason FROM v_fact f LEFT JOIN e USING (fact_id))"""
ELIGIBILITY_WATERFALL = f"WITH {_WATERFALL} SELECT owner, fact_id, reason FROM wf"
DIAGNOSTICS = f"WITH {_WATERFALL} SELECT reason, count(*) AS facts FROM wf GROUP BY reason"


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last six messages of each conversation, 600 characters each, while they stay within 2,400 in all, newest first."""
    rows = views.episodes(spark, sf_dir).withColumn("clipped", F.substring(F.coalesce("content", F.lit("")), 1, 600))
    w = maintenance.Window.partitionBy("owner").orderBy(F.desc("turn"), F.desc("episode_id"))
    rows = rows.withColumns({"place": F.row_number().over(w), "chars": F.sum(F.length("clipped")).over(w.rowsBetween(maintenance.Window.unboundedPreceding, 0))})
    return rows.where("place <= 6 and chars <= 2400").select("owner", "episode_id", "place", "chars")


CONTEXT_WINDOW = f"""WITH {views.EPISODES},
x AS (SELECT owner, episode_id, CAST(row_number() OVER w AS INTEGER) AS place, CAST(sum(length(substring(coalesce(content, ''), 1, 600))) OVER (PARTITION BY owner ORDER BY turn DESC, episode_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars
  FROM v_episode WINDOW w AS (PARTITION BY owner ORDER BY turn DESC, episode_id DESC))
SELECT * FROM x WHERE place <= 6 AND chars <= 2400"""


# Words that say nothing of a topic.
TOPIC_STOPS = ("我们", "你们", "他们", "这个", "那个", "什么", "怎么", "可以", "就是", "还是", "please", "about", "that", "this", "with")


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight most frequent terms of each conversation, without TOPIC_STOPS, ties by term: Latin words of three or more signs
    that begin with a letter, and Han runs of two to six."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"\p{IsHan}{2,6}|[a-z][a-z0-9+#.-]{2,}"), 0)
    words = views.episodes(spark, sf_dir).select("owner", F.explode(terms).alias("term")).where(~F.col("term").isin(*TOPIC_STOPS))
    counted = words.groupBy("owner", "term").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(maintenance.Window.partitionBy("owner").orderBy(F.desc("n"), "term"))).where("rank <= 8")


TOPIC_TERMS = f"""WITH {views.EPISODES},
t AS (SELECT owner, unnest(regexp_extract_all(lower(coalesce(content, '')), '\\p{{Han}}{{2,6}}|[a-z][a-z0-9+#.-]{{2,}}')) AS term FROM v_episode),
c AS (SELECT owner, term, count(*) AS n FROM t WHERE term NOT IN {TOPIC_STOPS} GROUP BY ALL)
SELECT owner, term, n, CAST(row_number() OVER (PARTITION BY owner ORDER BY n DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 8"""

QUERIES = {
    f.__name__: f
    for f in (
        temporal_current, temporal_asof, temporal_overlap, version_close, version_asof, change_classify, log_replay, capture_revisions, capacity_prune, feedback_signals, utility_score, tier_assign, feedback_asof,
        buckets_multi, summary_extract, exact_duplicates, rare_token_duplicates, occurrence_dedup, privacy_classify, safety_gate, strictest_policy, eligibility_waterfall, diagnostics, context_window, topic_terms,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
