"""Snapshot, payload and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, content string, status string, importance double, confidence double, memoryKey string, validFrom bigint, validTo bigint, createdAt bigint, updatedAt bigint, ownerId string, sourceMessageIds array<string>"
SNAPSHOT = "version int, items array<struct<" + ", ".join(f.replace(" ", ":", 1) for f in ITEM.split(", ")) + ">>"
PAYLOAD = "entities array<struct<id:string,type:string,text:string,start:int,end:int,score:double>>, facts array<struct<id:string,subject:string,predicate:string,object:string,score:double>>"


class BadSnapshot(ValueError):
    """A snapshot holds rows that can't be read; none are dropped in silence."""


def read_snapshots(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of JSON snapshots {version, items}: versions 1 to 3. Version 1 gets the defaults of the fields that
    it lacks. A reject is a file of another version, or an item without id or content; strict: any is an error."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    known = F.col("version").isin(1, 2, 3) & F.col("items").isNotNull()
    items = raw.where(known).select("file", "version", F.posexplode("items").alias("pos", "item"))
    bad = F.col("item").isNull() | F.col("item.id").isNull() | F.col("item.content").isNull()
    rejects = raw.where(~F.coalesce(known, F.lit(False))).select("file", F.lit(None).cast("int").alias("pos"), F.lit("version").alias("reason")).unionByName(items.where(bad).select("file", "pos", F.lit("item").alias("reason")))
    if strict and rejects.limit(1).count():
        raise BadSnapshot(f"unreadable rows below {path}")
    return upgraded(items.where(~bad).select("file", "version", "item.*")), rejects


def upgraded(items: DataFrame) -> DataFrame:
    """items with the defaults of version 1: importance 0.6, confidence 0.7, active, valid from their creation."""
    old = F.col("version") == 1
    put = lambda c, v: F.when(old, F.coalesce(c, v)).otherwise(F.col(c))
    return items.withColumns({"importance": put("importance", F.lit(0.6)), "confidence": put("confidence", F.lit(0.7)), "status": put("status", F.lit("active")), "validFrom": put("validFrom", F.col("createdAt"))})


def flattened_payload(rows: DataFrame, id: str, payload: Column, source: Column, most: int = 1000) -> DataFrame:
    """Mentions of extraction payloads: one row for each of the first `most` items that the format allows, with `reason`
    null when its span is the source's text and its score lies in [0, 1]. Offsets count code points."""
    parsed = rows.select(id, source.alias("_source"), F.from_json(payload, PAYLOAD).alias("p"))
    items = parsed.select(id, "_source", F.posexplode(F.slice("p.entities", 1, most)).alias("pos", "e"))
    cut = F.substring(F.col("_source"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    reason = F.when((F.col("e.start") < 0) | (F.col("e.end") <= F.col("e.start")) | ~cut.eqNullSafe(F.col("e.text")), "span").when(~F.col("e.score").between(0, 1), "score")
    return items.select(id, "pos", F.col("e.type").alias("type"), F.col("e.text").alias("text"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.score").alias("score"), reason.alias("reason"))


def best_mentions(mentions: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The best-scored mention of each (…, label, span), ties to the first position."""
    return mentions.groupBy(*by).agg(F.max(F.struct(score, (-F.col("pos")).alias("np"))).alias("b"), F.count("*").alias("n")).select(*by, F.col(f"b.{score}").alias(score), "n")


def listing(facts: DataFrame, after: tuple | None, order: str, id: str, n: int = 100) -> DataFrame:
    """Keyset page of 1 to 1000 rows, newest first: those after (order value, id) of the last row seen."""
    page = facts if after is None else facts.where((F.col(order) < F.lit(after[0])) | ((F.col(order) == F.lit(after[0])) & (F.col(id) > F.lit(after[1]))))
    return page.orderBy(F.desc(order), id).limit(max(1, min(1000, n)))


def write_by_owner(df: DataFrame, path: str, owner: str = "owner", buckets: int = 64) -> None:
    """Parquet, partitioned by a bucket of the owner, so that scans of one scope prune; one shuffle, files by bucket."""
    df.withColumn("owner_bucket", F.pmod(F.xxhash64(owner), F.lit(buckets))).repartition("owner_bucket").write.mode("overwrite").partitionBy("owner_bucket").parquet(path)
