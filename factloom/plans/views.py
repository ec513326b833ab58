"""Projections of the given tables onto the shapes that the operators work on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.temporal import close_intervals


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each order: owner, key, value, validity, status, importance, policy."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("valid_from"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("importance"),
        F.when(F.col("o_orderpriority").startswith("1"), "never").when(F.col("o_orderpriority").startswith("2"), "local-only").otherwise("allow-remote").alias("share"),
        F.when(F.col("o_orderpriority").startswith("1"), "secret").when(F.col("o_orderpriority").startswith("3"), "private").otherwise("normal").alias("sensitivity"),
    )
    return close_intervals(rows, ["owner"], "valid_from", "fact_id")


FACTS = """v_fact AS (
  SELECT o_custkey AS owner, o_orderkey AS fact_id, o_orderstatus AS value, o_orderdate AS valid_from, least(1.0, o_totalprice / 500000.0) AS importance,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'never' WHEN o_orderpriority LIKE '2%' THEN 'local-only' ELSE 'allow-remote' END AS share,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'secret' WHEN o_orderpriority LIKE '3%' THEN 'private' ELSE 'normal' END AS sensitivity,
    lead(o_orderdate) OVER w AS valid_to, lag(o_orderkey) OVER w AS supersedes,
    CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"), F.col("conv_id").alias("owner"), "turn", F.col("role").alias("actor"), F.col("text").alias("content"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
    )


EPISODES = """v_episode AS (
  SELECT conv_id * 1000 + turn AS episode_id, conv_id AS owner, turn, role AS actor, text AS content, sha256(coalesce(text, '')) AS content_hash FROM conversations
)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("episode_id"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.6).otherwise(0.3).alias("strength"), (F.col("l_linestatus") == "O").alias("active"),
    ).distinct()


LINKS = """v_link AS (
  SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS episode_id, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.6 ELSE 0.3 END AS strength, l_linestatus = 'O' AS active
  FROM lineitem
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical corpus: one shard for each source; documents of even id are active."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("shard"), "doc_id", "text", (F.col("doc_id") % 2 == 0).alias("active"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole text of every benchmark item; passage: its characters 11 to 90, which a relevant document holds."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text", F.substring("text", 11, 80).alias("passage"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "adopted").when(F.col("event_type") == "signup", "corrected").when(F.col("event_type") == "error", "denied")
    outcome = outcome.when(F.col("event_type") == "click", "injected").otherwise("retrieved")
    return e.select(
        "event_id", F.col("ts").alias("seen_at"), F.col("user_id").alias("owner"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint").alias("fact_id"), outcome.alias("outcome"), F.col("value").alias("latency")
    )


FEEDBACK = r"""v_feedback AS (
  SELECT event_id, ts AS seen_at, user_id AS owner, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS fact_id,
    CASE event_type WHEN 'purchase' THEN 'adopted' WHEN 'signup' THEN 'corrected' WHEN 'error' THEN 'denied' WHEN 'click' THEN 'injected' ELSE 'retrieved' END AS outcome, value AS latency
  FROM events
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples: a closed-form text statistic, rounded to 3 decimals, against the quality label; cohort: language."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    letters = F.length(F.regexp_replace("text", "[^a-z]", ""))
    score = F.round(letters / F.greatest(F.length("text"), F.lit(1)).cast("double"), 3)
    return labels.where("quality is not null").join(d, "doc_id").select("doc_id", F.coalesce(score, F.lit(0.0)).alias("score"), (F.col("quality") == 1).alias("relevant"), F.col("lang").alias("cohort"))


SAMPLES = """v_sample AS (
  SELECT doc_id, coalesce(round(length(regexp_replace(text, '[^a-z]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 3), 0.0) AS score, quality = 1 AS relevant, lang AS cohort
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-to-part edges between consecutive distinct lines of an order."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_returnflag").alias("kind"))
    return rows.where("dst is not null").distinct()


def edges_sql() -> str:
    return """v_line AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem),
v_step AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS dst, l_returnflag AS kind FROM v_line
), v_edge AS (SELECT DISTINCT src, dst, kind FROM v_step WHERE dst IS NOT NULL)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"),
        F.when(F.col("l_linestatus") == "O", "positive").otherwise("negative").alias("polarity"), F.col("l_shipdate").alias("valid_from"), (F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("valid_to"),
    ).distinct()


CLAIMS = """v_claim AS (
  SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS predicate, l_partkey AS subject, l_suppkey AS object,
    CASE WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS polarity, l_shipdate AS valid_from, l_shipdate + INTERVAL 90 DAY AS valid_to
  FROM lineitem
)"""


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
