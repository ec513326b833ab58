"""The gate between two strategies, reason by reason; and helpers that no query calls."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.operators import rollout, temporal
from factloom.sources import snapshots
from factloom.streaming import jobs

LOOSE = rollout.POLICY | {"cases": 4, "answerable": 2, "abstention": 1, "safety": 1, "recall_low": 0.05, "top1_low": 0.05, "abstained_low": 0.05, "behind": 9, "leak_high": 1.0, "failure_high": 1.0}
CASES = [(1, 10, "relevant"), (1, 11, "forbidden"), (2, 20, "relevant"), (2, 21, "relevant"), (3, None, None), (4, None, None)]
FINE = [(1, 10, 1, False), (2, 20, 1, False), (2, 21, 2, False)]


def gate(spark, new, policy=LOOSE, trusted=True, old=FINE):
    cases = spark.createDataFrame(CASES, "case_id long, fact_id long, role string")
    made = [rollout.outcomes(cases, spark.createDataFrame(r, "case_id long, fact_id long, rank int, failed boolean"), n) for r, n in ((old, "a"), (new, "b"))]
    rows = rollout.gate(rollout.report(*made), F.lit(trusted), policy).collect()
    return rows[0].decision, {r.check for r in rows if not r.passed}, {r.check: r.observed for r in rows}


@pytest.mark.parametrize(
    ("new", "policy", "trusted", "decision", "failed"),
    [
        (FINE, {}, True, "eligible-for-review", set()),
        (FINE, {}, False, "insufficient-data", {"trusted-purpose"}),
        (FINE, {"safety": 2, "abstention": 3}, True, "insufficient-data", {"minimum-safety", "minimum-abstention"}),
        ([*FINE, (1, 11, 2, False)], {}, True, "blocked", {"forbidden-leaks"}),
        ([*FINE, (3, None, None, True)], {}, True, "blocked", {"failure-rate"}),
        (FINE, {"recall_low": 0.99}, True, "blocked", {"recall-lower95"}),
        (FINE[:1], {"behind": 0.1}, True, "blocked", {"recall-not-behind", "top1-not-behind", "recall-not-behind-lower95", "top1-not-behind-lower95"}),
        ([*FINE, (3, 99, 1, False)], {"behind": 0.3}, True, "blocked", {"abstained-not-behind", "abstained-not-behind-lower95"}),
    ],
)
def test_each_reason(spark, new, policy, trusted, decision, failed):
    got = gate(spark, new, LOOSE | policy, trusted)
    assert got[0] == decision and got[1] == failed


def test_bounds_of_paired_differences(spark):
    observed = gate(spark, FINE[:1])[2]
    assert observed["recall-not-behind"] == -0.5
    assert observed["recall-not-behind-lower95"] == pytest.approx(-0.5 - 1.96 * 0.5**0.5 / 2**0.5, abs=1e-6)
    assert observed["minimum-cases"] == 4 and observed["minimum-safety"] == 1


def test_back_filled_ends(spark):
    t = lambda d, s=0: dt.datetime(2024, 1, d, 0, 0, s)
    rows = [(1, 1, t(1), None, "superseded", t(9)), (1, 2, t(5), None, "superseded", t(9)), (1, 3, t(5), None, "active", t(9)), (2, 4, t(2), None, "superseded", t(8)), (2, 5, t(3), t(4), "active", t(8))]
    df = spark.createDataFrame(rows, "o long, id long, start timestamp, valid_to timestamp, status string, updated timestamp")
    got = {r.id: r.valid_to for r in temporal.back_filled(df, ["o"], "start", "id", "updated").collect()}
    assert got == {1: t(5), 2: t(5, 1), 3: None, 4: t(3), 5: t(4)}
    assert temporal.back_filled(df.where("id = 4"), ["o"], "start", "id", "updated").first().valid_to == t(8)


def test_listing_by_keyset_meets_each_row_once(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, at long")
    seen, after = [], None
    while page := snapshots.listing(df, after, "at", "id", 4).collect():
        seen += [(r.at, r.id) for r in page]
        after = (page[-1].at, page[-1].id)
    assert seen == sorted(((i % 3, i) for i in range(10)), key=lambda x: (-x[0], x[1]))


def test_best_mentions_learned_evidence_and_sliding_latency(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.5), (1, "a", 1, 0.9), (1, "b", 2, 0.1)], "doc long, label string, pos int, score double")
    assert {(r.label, r.score, r.n) for r in snapshots.best_mentions(df, ["doc", "label"]).collect()} == {("a", 0.9, 2), ("b", 0.1, 1)}
    assert [r[0] for r in spark.createDataFrame([(0.2,), (0.625,), (1.0,)], "x double").select(F.round(scores.learned_evidence(F.col("x")), 6)).collect()] == [0.0, 0.5, 1.0]
    ticks = [(dt.datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 60, 5)]
    got = {r.start: (r.n, r.p50) for r in jobs.sliding_latency(spark.createDataFrame(ticks, "ts timestamp, value double")).collect()}
    assert got[dt.datetime(2024, 1, 1)] == (12, 25.0) and got[dt.datetime(2024, 1, 1, 0, 50)][0] == 2


def test_sliding_latency_and_sessions_of_a_stream_with_a_late_row(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    at = str(tmp_path / "in")
    day = dt.datetime(2024, 1, 1)
    times = iter(range(1_700_000_000, 1_800_000_000, 10))

    def put(*rows):
        before = set(glob.glob(f"{at}/*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        for name in set(glob.glob(f"{at}/*.parquet")) - before:  # files are read in order of their times
            os.utime(name, (t := next(times), t))

    first = [(1, day + dt.timedelta(minutes=m), float(m)) for m in (0, 10, 20)]
    late = (1, day + dt.timedelta(minutes=35), 35.0)  # joins the session while the watermark allows it
    put(*first)
    put((1, day + dt.timedelta(minutes=75), 75.0))
    put(late)
    put((2, day + dt.timedelta(hours=9), 1.0))
    put((2, day + dt.timedelta(hours=12), 1.0))  # rows are late by the watermark of the batch before
    put((1, day + dt.timedelta(minutes=50), 50.0))  # hours behind it: dropped
    put((3, day + dt.timedelta(days=1), 1.0))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    batch = spark.createDataFrame([*first, (1, day + dt.timedelta(minutes=75), 75.0), late, (2, day + dt.timedelta(hours=9), 1.0), (2, day + dt.timedelta(hours=12), 1.0), (3, day + dt.timedelta(days=1), 1.0)], schema)
    closed = F.col("start") < F.lit(day + dt.timedelta(hours=8))
    for name, make in (("late_sessions", jobs.sessions), ("late_sliding", jobs.sliding_latency)):
        out = jobs.drained(make(stream()), name, str(tmp_path / name))
        assert sorted(map(tuple, out.where(closed).collect()), key=str) == sorted(map(tuple, make(batch).where(closed).collect()), key=str), name
