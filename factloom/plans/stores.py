"""Queries on stores that take batches: vectors by content, and a mirror of order changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.embedding_store import EmbeddingStore
from factloom.operators.tables import shared_dir
from factloom.plans import views
from factloom.sources.versioned import VersionedTable

MODELS = ("base", "next")


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[EmbeddingStore, DataFrame]:
    """A store that took the vectors of all documents that have one, then those of another model for every third; after that every
    fifth text changed, every 25th of those was embedded again, and every eleventh document's vectors were removed."""
    docs = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.coalesce("text", F.lit("")).alias("content"))
    vectors = views.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vector"))
    rows = docs.join(vectors, "fact_id")
    changed = docs.withColumn("content", F.when(F.col("fact_id") % 5 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    store = EmbeddingStore(spark, _folder(spark, "embeddings"), 8)
    store.put(rows.withColumn("model", F.lit(MODELS[0])), 1)
    store.put(rows.where("fact_id % 3 = 0").withColumn("model", F.lit(MODELS[1])), 2)
    store.put(changed.join(vectors, "fact_id").where("fact_id % 25 = 0").withColumn("model", F.lit(MODELS[0])), 3)
    store.remove(docs.where("fact_id % 11 = 0").select("fact_id"), 4)
    return store, changed


def vector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's vector of each model is ready, stale or missing after all batches."""
    store, docs = _embedded(spark, sf_dir)
    return store.states(docs, list(MODELS))


VECTOR_STATES = """WITH d AS (SELECT doc_id AS fact_id, doc_id IN (SELECT vec_id FROM embeddings) AS has FROM documents), m(model) AS (VALUES ('base'), ('next'))
SELECT fact_id, model, CASE WHEN NOT has OR fact_id % 11 = 0 OR (model = 'next' AND fact_id % 3 <> 0) THEN 'missing' WHEN fact_id % 5 = 0 AND (model = 'next' OR fact_id % 25 <> 0) THEN 'stale' ELSE 'ready' END AS state FROM d, m"""


def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that are ready, by their length and sum, and the documents that wait for one."""
    store, docs = _embedded(spark, sf_dir)
    ready = store.vectors(docs, MODELS[0]).select("fact_id", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
    waits = store.pending(docs, MODELS[0]).select("fact_id", F.lit(None).cast("int").alias("dims"), F.lit(None).cast("double").alias("total"))
    return ready.unionByName(waits)


VECTOR_LOOKUP = """WITH d AS (SELECT doc_id AS fact_id, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT fact_id, CASE WHEN ok THEN len(embedding) END AS dims, CASE WHEN ok THEN round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) END AS total
FROM (SELECT *, embedding IS NOT NULL AND fact_id % 11 <> 0 AND (fact_id % 5 <> 0 OR fact_id % 25 = 0) AS ok FROM d)"""


def mirror_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a change log in three batches, the middle one sent twice and the newest first: each customer's newest order is the
    row that the mirror holds, and an order that was cancelled (status P) deletes the row. Orders of one time and one last three
    digits tie: then a deletion counts, and of several the one whose number is the last as text, as VersionedTable says."""
    o = views.read(spark, sf_dir, "orders")
    change = o.select(F.col("o_custkey").alias("key"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey") % 1000).alias("seq"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("upsert").alias("op"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"))
    table = VersionedTable(spark, _folder(spark, "mirror"), "key long, seq long, op string, order_id long, price double", buckets=8)
    parts = [change.where(F.col("order_id") % 3 == i) for i in (2, 1, 1, 0)]
    for part, number in zip(parts, (0, 1, 1, 2), strict=True):
        table.merge(part, "orders", number)
    return table.read()


MIRROR_BATCHES = """WITH c AS (SELECT o_custkey AS key, epoch_us(o_orderdate) * 1000 + o_orderkey % 1000 AS seq, o_orderstatus, o_orderkey AS order_id, o_totalprice AS price FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, o_orderstatus = 'P' DESC, CAST(order_id AS VARCHAR) DESC) AS n FROM c)
SELECT key, seq, order_id, price FROM n WHERE n = 1 AND o_orderstatus <> 'P'"""

QUERIES = {f.__name__: f for f in (vector_states, vector_lookup, mirror_batches)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
