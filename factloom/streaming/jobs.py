"""Event-driven paths as Structured Streaming: the same rows as the batch functions, with watermarks for late data."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.sources.versioned import VersionedTable

OUTCOMES = {"purchase": "adopted", "signup": "corrected", "error": "denied", "click": "injected"}


def event_stream(spark: SparkSession, folder: str, schema, per_batch: int = 1) -> DataFrame:
    """Events below a folder as a stream; times without a zone become UTC timestamps, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return with_outcome(raw)


def with_outcome(events: DataFrame) -> DataFrame:
    outcome = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in OUTCOMES.items()), F.lit("retrieved"))
    return events.withColumns({"ts": F.col("ts").cast("timestamp"), "outcome": outcome, "fact_id": F.get_json_object("props", "$.k").cast("bigint")})


def idempotent(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """A repeated key within the delay is dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def daily_telemetry(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by outcome and mean latency of each day."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    g = marked.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), *(of(o) for o in ("adopted", "corrected", "denied", "injected", "retrieved")), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("day"), "n", "adopted", "corrected", "denied", "injected", "retrieved", "mean")


def sliding_latency(events: DataFrame, late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    g = marked.groupBy(F.window("ts", "1 hour", "10 minutes").alias("w")).agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 1000).alias("p"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session buckets of each user; a late event within the delay widens or joins them."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    g = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_counters(events: DataFrame) -> DataFrame:
    """Access and feedback counters of each fact; update mode as a stream."""
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return events.where("fact_id is not null").groupBy("fact_id").agg(of("adopted"), of("corrected"), of("denied"), F.count("*").alias("accesses"))


def matched_feedback(retrievals: DataFrame, reports: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Reports with the retrievals of the same user and fact in the time before them; a report without any stays, once the
    watermark says that none can come."""
    shown = retrievals.select(F.col("event_id").alias("retrieval_id"), F.col("user_id").alias("r_user"), F.col("fact_id").alias("r_fact"), F.col("ts").alias("r_ts"))
    told = reports.select("event_id", "outcome", "user_id", "fact_id", "ts")
    if told.isStreaming:
        shown, told = shown.withWatermark("r_ts", late), told.withWatermark("ts", late)
    same = (F.col("user_id") == F.col("r_user")) & (F.col("fact_id") == F.col("r_fact"))
    return told.join(shown, same & (F.col("r_ts") <= F.col("ts")) & (F.col("r_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}")), "left_outer")


def expiry(events: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(fact_id, last_seen, status): a fact expires when no event has touched it for some hours of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"fact_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")], "status": ["expired"]})
            return
        last = state.get[0] if state.exists else 0
        for rows in batches:
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    return (
        events.where("fact_id is not null").withWatermark("ts", late).groupBy("fact_id")
        .applyInPandasWithState(step, "fact_id long, last_seen timestamp, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def mirrored(changes: DataFrame, table: VersionedTable, checkpoint: str, source: str | None = None) -> StreamingQuery:
    """A change stream mirrored into a table: each micro-batch rewrites the buckets of its keys and then publishes a version. A
    batch that is sent again changes nothing; with a new checkpoint, another source, the table stays and is merged into."""

    def merge(batch: DataFrame, epoch: int) -> None:
        table.merge(batch, source or checkpoint, epoch)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "append", **options: Any) -> DataFrame:
    """All that a stream gives now, as a table in memory: for tests and small backfills."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
