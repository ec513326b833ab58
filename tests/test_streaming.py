"""Streams give the rows of the batch functions; late, repeated and expired events take their defined way."""

import pytest
from pyspark.sql import functions as F

from core_helpers import SF
from factloom.sources.versioned import VersionedTable
from factloom.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in three files, in time order, and a last file that moves the watermark past all windows."""
    at = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    third = F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))
    parted = events.withColumn("k", third)
    for k in (1, 2, 3):
        parted.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(at)
    return at, events


def end_mark(spark, events, at):
    last = events.orderBy(F.desc("ts")).limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")})
    last.select(events.columns).coalesce(1).write.mode("append").parquet(at)


def rows(df):
    return sorted(map(str, df.collect()))


def test_daily_windows_equal_batch(spark, folder, tmp_path):
    at, events = folder
    out = jobs.drained(jobs.daily_telemetry(jobs.event_stream(spark, at, events.schema)), "daily", str(tmp_path / "c"), "complete")
    fix = lambda d: d.withColumn("mean", F.round("mean", 6))
    assert rows(fix(out)) == rows(fix(jobs.daily_telemetry(jobs.with_outcome(events))))


def test_counters_equal_batch(spark, folder, tmp_path):
    at, events = folder
    out = jobs.drained(jobs.running_counters(jobs.event_stream(spark, at, events.schema)), "counters", str(tmp_path / "c"), "complete")
    assert rows(out) == rows(jobs.running_counters(jobs.with_outcome(events)))


def test_repeated_events_are_dropped(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(50)
    at = str(tmp_path / "in")
    events.coalesce(1).write.parquet(at)
    events.coalesce(1).write.mode("append").parquet(at)
    out = jobs.drained(jobs.idempotent(jobs.event_stream(spark, at, events.schema), late="90 days"), "once", str(tmp_path / "c"))
    assert out.count() == 50


def test_feedback_join_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    at = str(tmp_path / "in")
    events.coalesce(1).write.parquet(at)
    end_mark(spark, events, at)
    shown, told = "outcome in ('retrieved', 'injected')", "outcome in ('adopted', 'corrected', 'denied')"
    live = lambda: jobs.event_stream(spark, at, events.schema, 10)
    out = jobs.drained(jobs.matched_feedback(live().where(shown), live().where(told), "2 DAYS"), "fb", str(tmp_path / "c"))
    batch = jobs.with_outcome(events)
    want = jobs.matched_feedback(batch.where(shown), batch.where(told), "2 DAYS")
    matched = lambda d: rows(d.where("retrieval_id is not null").select("event_id", "retrieval_id"))
    assert matched(out) == matched(want)


CHANGES = "id long, seq long, op string, v string"


def put(spark, at, *rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(at)


def test_mirror_rewrites_touched_buckets_and_publishes_whole_versions(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = VersionedTable(spark, out, CHANGES, "id", "seq", buckets=8)
    put(spark, at, *((i, 1, "upsert", "a") for i in range(40)))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(at)
    run = lambda c, source=None: jobs.mirrored(stream, table, str(tmp_path / c), source).awaitTermination()
    run("c")
    assert table.versions() == [0] and table.read().count() == 40 and len(table.manifest()) == 8
    before = {b: m["folder"] for b, m in table.manifest().items()}
    put(spark, at, (7, 3, "upsert", "b"), (7, 2, "upsert", "late"))
    run("c")
    run("c")
    after = {b: m["folder"] for b, m in table.manifest().items()}
    assert table.versions() == [0, 1] and sum(before[b] != after[b] for b in before) == 1, "one key, one bucket"
    assert table.read().where("id = 7").first().v == "b" and table.read(0).where("id = 7").first().v == "a"
    put(spark, at, (7, 5, "delete", None), (8, 4, "upsert", "c"))
    put(spark, at, (7, 4, "upsert", "too late"))
    run("c")
    assert table.read().count() == 39 and table.read().where("id = 7").count() == 0
    run("other")  # a new checkpoint sends all files again
    assert table.read().count() == 39 and table.read().where("id = 8").first().v == "c"
    spark.createDataFrame([(1, 99, "upsert", "unpublished")], CHANGES).write.parquet(f"{out}/data/version=77/bucket=1")
    assert table.read().where("v = 'unpublished'").count() == 0
    kept = {tuple(r) for r in table.read().collect()}
    assert table.forget(1) > 0 and {tuple(r) for r in table.read().collect()} == kept


def test_any_order_of_batches_gives_one_table(spark, tmp_path):
    import random

    rows = [(i % 5, s, "delete" if s % 4 == 0 else "upsert", f"v{s}") for i, s in zip(range(40), range(40), strict=True)] + [(None, 1, "upsert", "x"), (1, 36, "upsert", "tie")]
    seen = []
    for n in range(2):
        random.Random(n).shuffle(rows)
        table = VersionedTable(spark, str(tmp_path / f"t{n}"), CHANGES, "id", "seq", buckets=3)
        for at in range(0, len(rows), 14):
            table.merge(spark.createDataFrame(rows[at : at + 14], CHANGES))
        assert not table.merge(spark.createDataFrame([], CHANGES))
        seen.append(sorted(map(tuple, table.read().collect())))
    assert seen[0] == seen[1] and VersionedTable(spark, str(tmp_path / "none"), CHANGES, "id", "seq").read().count() == 0


def test_expiry_fires_after_silence(spark, tmp_path):
    at = str(tmp_path / "in")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    put = lambda i, ts, k: spark.sql(f"SELECT {i}L event_id, TIMESTAMP_NTZ '{ts}' ts, 1L user_id, 'view' event_type, 1.0D value, '{{\"k\": {k}}}' props").coalesce(1).write.mode("append").parquet(at)
    put(1, "2024-01-01 00:00:00", 7)
    stream = jobs.expiry(jobs.event_stream(spark, at, spark.createDataFrame([], schema).schema))
    jobs.drained(stream, "expiry1", str(tmp_path / "c"))
    put(2, "2024-01-05 00:00:00", 8)
    put(3, "2024-01-05 01:00:00", 8)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.fact_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [7]
