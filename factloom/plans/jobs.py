"""Queries on selection, payload flattening, segments, and the batch forms of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import lexical, selection
from factloom.operators.tables import kept
from factloom.plans import retrieval, views
from factloom.sources import snapshots
from factloom.streaming import jobs


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each phrase, with the words of their texts: texts that no phrase has among its best are not read
    into words, nor shuffled."""
    top = kept(lexical.top_per(retrieval._bm25(spark, sf_dir), ["query_id"], selection.MOST, F.desc("score"), F.asc("id")).select("query_id", "id", "score"), "candidates")
    small = F.broadcast if top.count() <= lexical.TERMS else lambda df: df
    docs = views.read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").join(small(top.select("id").distinct()), "id", "left_semi")
    return docs.select("id", F.array_distinct(text.word_tokens("text")).alias("tokens"), F.col("n_chars").cast("int").alias("chars")).join(small(top), "id")


def diverse_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.chosen_per_query(_candidates(spark, sf_dir), selection.diverse(8, 0.6))


def adaptive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.chosen_per_query(_candidates(spark, sf_dir), selection.adaptive(10))


def evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = views.benchmark_queries(spark, sf_dir).select("query_id", text.word_tokens("text").alias("need"))
    rows = _candidates(spark, sf_dir).join(queries, "query_id")
    return selection.chosen_per_query(rows, selection.sufficient(lambda r: set(r["need"]), 6))


def payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction payloads made from all documents, and their mentions one by one: the first Latin word of each text at its
    place, some with another text or a score out of range; a text without one has a mention that lies nowhere."""
    docs = views.read(spark, sf_dir, "documents")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)
    start = F.when(word == "", -1).otherwise(F.instr("text", word) - 1)
    item = F.struct(
        F.lit("m1").alias("id"), F.when(F.col("doc_id") % 2 == 0, "Person").otherwise("Place").alias("type"), F.when(F.col("doc_id") % 11 == 0, F.concat(word, F.lit("!"))).otherwise(word).alias("text"),
        start.alias("start"), (start + F.length(word)).alias("end"), F.when(F.col("doc_id") % 13 == 0, 1.5).otherwise((F.col("doc_id") % 10) / 10.0).alias("score"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("entities")))
    return snapshots.flattened_payload(docs.withColumn("payload", payload), "doc_id", F.col("payload"), F.col("text"))


PAYLOAD_FLATTEN = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS word FROM documents),
e AS (SELECT doc_id, word, CASE WHEN word = '' THEN -1 ELSE strpos(t, word) - 1 END AS start FROM d)
SELECT doc_id, 0 AS pos, CASE WHEN doc_id % 2 = 0 THEN 'Person' ELSE 'Place' END AS type, CASE WHEN doc_id % 11 = 0 THEN word || '!' ELSE word END AS text, start, start + length(word) AS end,
  CASE WHEN doc_id % 13 = 0 THEN 1.5 ELSE (doc_id % 10) / 10.0 END AS score, CASE WHEN word = '' OR doc_id % 11 = 0 THEN 'span' WHEN doc_id % 13 = 0 THEN 'score' END AS reason FROM e"""


def segment_documents(spark: SparkSession, sf_dir: str, size: int = 1800) -> DataFrame:
    """Documents cut into segments of at most 1,800 characters that end at the last sentence end of their second half.

    One pass over each text's windows: an aggregate carries the place where the next segment begins."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    steps = F.sequence(F.lit(1), F.ceil(F.length("text") / (size / 2)).cast("int"))
    none = F.array().cast("array<int>")

    def cut(ends, _):
        at = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
        piece = F.substring(F.col("text"), at + 1, F.lit(size))
        tail = F.substring(piece, size // 2 + 1, size // 2)
        sentence = F.length(F.regexp_extract(tail, r"(?s)^(.*[.!?\n])", 1))
        whole = at + size >= F.length("text")
        end = F.when(whole, F.length("text")).when(sentence > 0, at + size // 2 + sentence).otherwise(at + size)
        return F.when(at >= F.length("text"), ends).otherwise(F.concat(ends, F.array(end.cast("int"))))

    held = docs.withColumn("ends", F.aggregate(steps, none, cut))
    rows = held.select("doc_id", "ends", F.posexplode("ends").alias("segment", "end"))
    start = F.when(F.col("segment") == 0, 0).otherwise(F.get("ends", F.col("segment") - 1))
    return rows.select("doc_id", "segment", start.alias("start"), "end")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.daily_telemetry(jobs.with_outcome(views.read(spark, sf_dir, "events")))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "adopted", "corrected", "denied", "injected", "retrieved", F.round("mean", 4).alias("mean"))


STREAM_DAILY = f"""WITH {views.FEEDBACK} SELECT strftime(seen_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (outcome = 'adopted') AS adopted, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'denied') AS denied,
  count(*) FILTER (outcome = 'injected') AS injected, count(*) FILTER (outcome = 'retrieved') AS retrieved, round(avg(latency), 4) AS mean FROM v_feedback GROUP BY 1"""


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.running_counters(jobs.with_outcome(views.read(spark, sf_dir, "events")))


STREAM_COUNTERS = f"""WITH {views.FEEDBACK} SELECT fact_id, count(*) FILTER (outcome = 'adopted') AS adopted, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'denied') AS denied, count(*) AS accesses
FROM v_feedback WHERE fact_id IS NOT NULL GROUP BY fact_id"""


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.sessions(jobs.with_outcome(views.read(spark, sf_dir, "events")), "2 hours")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


STREAM_SESSIONS = f"""WITH {views.FEEDBACK}, g AS (SELECT owner, event_id, seen_at, CASE WHEN seen_at < lag(seen_at) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS st FROM v_feedback WINDOW w AS (PARTITION BY owner ORDER BY seen_at, event_id)),
s AS (SELECT owner, sum(st) OVER (PARTITION BY owner ORDER BY seen_at, event_id) AS k FROM g), c AS (SELECT owner, k, count(*) AS n FROM s GROUP BY owner, k)
SELECT owner AS user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY owner"""


def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the number of retrievals of the same user and fact in the two days before."""
    events = jobs.with_outcome(views.read(spark, sf_dir, "events"))
    matched = jobs.matched_feedback(events.where("outcome in ('retrieved', 'injected')"), events.where("outcome in ('adopted', 'corrected', 'denied')"), "2 DAYS")
    return matched.groupBy("event_id", "outcome").agg(F.count("retrieval_id").alias("retrievals"), F.max("retrieval_id").alias("last_id"))


STREAM_FEEDBACK = f"""WITH {views.FEEDBACK}
SELECT a.event_id, a.outcome, count(b.event_id) AS retrievals, max(b.event_id) AS last_id FROM v_feedback a LEFT JOIN v_feedback b
  ON a.owner = b.owner AND a.fact_id = b.fact_id AND b.outcome IN ('retrieved', 'injected') AND b.seen_at <= a.seen_at AND b.seen_at >= a.seen_at - INTERVAL 2 DAY
WHERE a.outcome IN ('adopted', 'corrected', 'denied') GROUP BY a.event_id, a.outcome"""


def hashed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest documents by hashed embedding for each benchmark phrase, within the documents that share a dimension
    with it."""
    from factloom.operators import vectors
    from factloom.operators.lexical import top_per

    docs = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    scored = vectors.nearest(views.benchmark_queries(spark, sf_dir), docs, "text", 5).select("query_id", "id", F.round("score", 6).alias("score"))
    return top_per(scored, ["query_id"], 5, F.desc("score"), F.asc("id")).select("query_id", "id", "rank", "score")


QUERIES = {f.__name__: f for f in (diverse_cut, adaptive_select, evidence_select, payload_flatten, segment_documents, stream_daily, stream_counters, stream_sessions, stream_feedback, hashed_neighbours)}
ORACLES = {"payload_flatten": PAYLOAD_FLATTEN, "stream_daily": STREAM_DAILY, "stream_counters": STREAM_COUNTERS, "stream_sessions": STREAM_SESSIONS, "stream_feedback": STREAM_FEEDBACK}
