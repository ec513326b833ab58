"""Vectors addressed by content: a vector counts for a fact and a model as long as the fact's text is the one it was made of.

The store holds no text, only its hash. A text that changes makes its vector stale at once, without a write; what has to be
made anew is an anti-join of facts with the store. Vectors of several models lie side by side and never mix. The store is a
versioned table, so that a batch of vectors rewrites the buckets of its facts alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import normalised
from factloom.sources.versioned import VersionedTable

SCHEMA = "key string, seq long, op string, fact_id long, model string, hash string, vector array<double>"


def content_hash(content: Column) -> Column:
    """Hash of a text in its normal form, whole."""
    return F.sha2(normalised(content, 2**31 - 1), 256)


def _key(fact_id: Column, model: Column) -> Column:
    return F.concat_ws("/", fact_id.cast("string"), model)


def is_vector(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector has components, all finite, and as many as the model's."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims if dims else F.size(vector) > 0) & fine, F.lit(False))


class EmbeddingStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = VersionedTable(spark, path, SCHEMA, "key", "seq", buckets)

    def put(self, vectors: DataFrame, seq: int) -> DataFrame:
        """vectors (fact_id, model, content, vector), made of these texts; seq grows from batch to batch. Returns rows that aren't
        vectors, which are left out."""
        good = vectors.where(is_vector(F.col("vector")))
        rows = good.select(_key(F.col("fact_id"), F.col("model")).alias("key"), F.lit(seq).cast("long").alias("seq"), F.lit("upsert").alias("op"), "fact_id", "model", content_hash(F.col("content")).alias("hash"), F.col("vector").cast("array<double>").alias("vector"))
        self.table.merge(rows)
        return vectors.where(~is_vector(F.col("vector")))

    def remove(self, gone: DataFrame, seq: int) -> None:
        """Drops the vectors of facts (fact_id), of all models, or of (fact_id, model)."""
        on = [c for c in ("fact_id", "model") if c in gone.columns]
        held = self.table.read().join(gone.select(*on).distinct(), on, "left_semi")
        self.table.merge(held.select("key", F.lit(seq).cast("long").alias("seq"), F.lit("delete").alias("op"), "fact_id", "model", "hash", F.lit(None).cast("array<double>").alias("vector")))

    def states(self, facts: DataFrame, models: list[str]) -> DataFrame:
        """facts (fact_id, content) x models -> (fact_id, model, state): ready, stale (made of another text), or missing."""
        wanted = facts.select("fact_id", content_hash(F.col("content")).alias("now"), F.explode(F.array(*map(F.lit, models))).alias("model"))
        held = self.table.read().select("fact_id", "model", "hash")
        met = wanted.join(held, ["fact_id", "model"], "left")
        return met.select("fact_id", "model", F.when(F.col("hash").isNull(), "missing").when(F.col("hash") != F.col("now"), "stale").otherwise("ready").alias("state"))

    def pending(self, facts: DataFrame, model: str) -> DataFrame:
        """facts without a vector of this model that was made of their text: what is to be embedded."""
        held = self.table.read().where(F.col("model") == model).select("fact_id", F.col("hash").alias("_hash"))
        return facts.withColumn("_hash", content_hash(F.col("content"))).join(held, ["fact_id", "_hash"], "left_anti").drop("_hash")

    def vectors(self, facts: DataFrame, model: str) -> DataFrame:
        """(fact_id, vector) of the facts whose vector is ready."""
        held = self.table.read().where(F.col("model") == model).select("fact_id", F.col("hash").alias("_hash"), "vector")
        return facts.select("fact_id", content_hash(F.col("content")).alias("_hash")).join(held, ["fact_id", "_hash"]).select("fact_id", "vector")
