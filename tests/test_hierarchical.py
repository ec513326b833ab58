"""Hierarchical recall: tiers, what a key says of a concept, and a second stage for open requests alone."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import hierarchical as g
from factloom.operators import hybrid

FACTS = "owner long, id long, content string, kind string, key string, importance double, confidence double, status string, age_days double, utility double, assigned string"
ROWS = [
    (1, 11, "用户姓名/名字：小林", "identity", "profile.name", 0.8, 0.9, "active", 10.0, 0.9, "hot"),
    (1, 12, "用户所在地：无锡", "identity", "profile.location", 0.8, 0.9, "active", 5.0, 0.8, "cold"),
    (1, 13, "用户所在地：苏州", "identity", "profile.location", 0.8, 0.9, "superseded", 50.0, 0.7, "hot"),
    (1, 14, "User preference：jazz music", "preference", None, 0.8, 0.9, "active", 30.0, 0.6, None),
    (1, 15, "用户职业：护士", "identity", "profile.occupation", 0.8, 0.9, "active", 3.0, 0.5, "quarantine"),
    (2, 21, "用户姓名/名字：阿宁", "identity", "profile.name", 0.8, 0.9, "active", 10.0, 0.4, "warm"),
]
ASKS = {1: (1, "我叫什么名字"), 2: (1, "我住在哪个城市"), 3: (1, "我以前住在哪里"), 4: (1, "What is the weather today?"), 5: (1, "我的职业是什么"), 6: (2, "我叫什么名字"), 7: (9, "我叫什么名字")}


@pytest.fixture(scope="module")
def recall(spark):
    asked = g.routed(hybrid.planned(spark.createDataFrame([(i, *a) for i, a in ASKS.items()], "request_id long, owner long, text string")))
    facts = spark.createDataFrame(ROWS, FACTS)
    notes = facts.where("status = 'active'").groupBy("owner", "kind").agg(F.concat_ws("；", F.collect_list("content")).alias("content"), F.collect_list("id").alias("facts"))
    index = g.Index(facts, notes.select("owner", F.concat_ws("/", "owner", "kind").alias("id"), "content", "facts"))
    return asked, index, g.recalled(asked, index).collect()


def test_tiers_and_stages(recall):
    asked, index, found = recall
    got = {(r.request_id, r.rank): (r.id, r.tier, r.stage) for r in found}
    assert got[1, 1] == (11, "hot", 1) and got[6, 1] == (21, "warm", 1)
    assert got[2, 1] == (12, "cold", 2), "nothing hot or warm answers, so that the cold tier is read"
    assert got[3, 1][1:] == ("cold", 1) and {v[0] for k, v in got.items() if k[0] == 3} == {12, 13}, "the past is asked for: cold at once"
    assert not {k[0] for k in got} & {4, 5, 7}, "external, held back, unknown owner"


def test_the_second_stage_reads_the_cold_folder_for_open_requests(recall):
    asked, index, _ = recall
    asks = asked.where("policy <> 'disabled'")
    lead = g.leading(asks, index)
    first = g.ranking(asks, g.candidates(asks, index, ("hot", "warm")).unionByName(g.candidates(asks.where("policy = 'eager'"), index, ("cold",))), lead, index)
    waiting = g.still_open(asks, first)
    assert {r.request_id for r in waiting.collect()} == {2, 5, 7}
    plan = index.posted.where(F.col("tier").isin("cold"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tier" in plan and "cold" in plan
    assert index.posted.where(F.col("tier").isin("cold")).select("id").distinct().count() == 2


def test_concepts_of_keys(spark):
    rows = [("profile.name", ["profile.name"], "specific", 1.0), ("profile", ["profile.name"], "specific", 0.86), ("profile.name", ["profile"], "specific", 0.86), ("x", [], "enumerative", 0.72), ("preference.color", ["preference.any"], "specific", 0.65),
            ("preference.color", ["preference.any", "preference.book"], "specific", 0.0), ("profile.name", ["profile.location"], "specific", 0.0), ("profile.names", ["profile.name"], "specific", 0.0)]
    df = spark.createDataFrame(rows, "key string, concepts array<string>, intent string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", g.concept_evidence(F.col("key"), F.col("concepts"), F.col("intent"))).collect())
