"""Hybrid and adaptive recall: plans, routes, abstention and the reasons for which selection ends."""

import pytest

from factloom.operators import hybrid as h

FACTS = "owner long, id long, content string, kind string, importance double, confidence double, status string, age_days double, uses long, supersedes long, sources array<long>"
ROWS = [
    (1, 11, "用户姓名/名字：小林", "identity", 0.8, 0.9, "active", 10.0, 0, None, [1]),
    (1, 12, "用户所在地：无锡", "identity", 0.8, 0.9, "active", 5.0, 0, 13, [2]),
    (1, 13, "用户所在地：苏州", "identity", 0.8, 0.9, "superseded", 50.0, 0, None, [3]),
    (1, 14, "User preference：jazz music", "preference", 0.8, 0.9, "active", 30.0, 0, None, [4]),
    (1, 15, "用户明确希望记住：the gate code is ZX91", "explicit", 0.95, 0.9, "active", 3.0, 0, None, [5]),
    (1, 16, "用户明确希望记住：bring the blue folder", "explicit", 0.95, 0.9, "active", 3.0, 0, None, [5]),
    (2, 21, "用户姓名/名字：阿宁", "identity", 0.8, 0.9, "active", 10.0, 0, None, [1]),
]
ASKS = {
    1: (1, "我叫什么名字"), 2: (1, "What is the weather today?"), 3: (1, "Which quantum paper?"), 4: (1, "我以前住在哪里"), 5: (1, "gate code ZX91"), 6: (1, "we talked about the gate code"),
    7: (1, None), 8: (3, "我叫什么名字"), 9: (1, "recap everything about me"), 10: (1, "Which music do I like?"),
}


@pytest.fixture(scope="module")
def recall(spark):
    asked = h.planned(spark.createDataFrame([(i, *a) for i, a in ASKS.items()], "request_id long, owner long, text string"))
    facts = spark.createDataFrame(ROWS, FACTS)
    ranked = h.recalled(asked, h.index(facts))
    chosen = h.adaptive(asked, ranked).collect()
    return {r.request_id: r for r in asked.collect()}, ranked.collect(), chosen, {r.id: r.uses for r in h.used(facts, spark.createDataFrame([(1, 11), (2, 11), (3, None)], "request_id long, id long")).collect()}


def test_plans(recall):
    plans = recall[0]
    assert {i: p.intent for i, p in plans.items()} == {1: "specific", 2: "external", 3: "specific", 4: "temporal", 5: "specific", 6: "specific", 7: "external", 8: "specific", 9: "enumerative", 10: "multi-fact"}
    assert plans[4].mode == "historical" and plans[4].routes == ["lexical", "semantic", "structured", "temporal"]
    assert plans[6].routes == ["lexical", "semantic", "episode"] and plans[9].broad and plans[2].routes == []


def test_rankings(recall):
    by = {}
    for r in sorted(recall[1], key=lambda r: (r.request_id, r.rank)):
        by.setdefault(r.request_id, []).append(r.id)
    assert by[1] == [11] and by[4][0] == 13 and 12 in by[4] and by[5][0] == 15
    assert 16 in by[6], "a fact of the same message as the best hit"
    assert set(by[9]) == {11, 12, 14, 15, 16} and by[10][0] == 14
    assert not {2, 7, 8} & set(by)


def test_selection_and_abstention(recall):
    got = {}
    for r in recall[2]:
        got.setdefault(r.request_id, []).append((r.id, r.stopped))
    assert got[1] == [(11, "coverage-satisfied")]
    assert got[2] == got[7] == [(None, "memory-not-needed")]
    assert got[3] == got[8] == [(None, "abstain-low-confidence")]
    assert {i for i, _ in got[9]} == {11, 12, 14, 15, 16}
    assert set(got) == set(ASKS)


def test_uses_are_counted(recall):
    assert recall[3][11] == 2 and recall[3][12] == 0


def rows(*scores, words=None, concepts=()):
    return [{"score": s, "content": f"c{i}", "concepts": list(concepts), "words": {f"w{i}"} if words is None else set(words)} for i, s in enumerate(scores)]


PLAN = {"concepts": [], "broad": False, "mode": "current", "first": 4, "later": 4, "batches": 3, "most": 8, "chars": 2400}


@pytest.mark.parametrize(
    ("found", "plan", "taken", "why"),
    [
        (rows(1.0, 0.95, 0.5, 0.4, 0.4), {}, 2, "coverage-satisfied"),
        (rows(1.0, 0.95, 0.9, words=["same"]), {}, 1, "coverage-satisfied"),
        (rows(*[1.0] * 30), {"broad": True}, 8, "max-injected"),
        (rows(*[1.0] * 30), {"broad": True, "chars": 5}, 2, "character-budget"),
        (rows(1.0, 0.9, 0.8, 0.7, 0.2), {"broad": True}, 4, "score-drop"),
        (rows(*[1.0] * 4, *[0.5] * 9), {"broad": True}, 4, "marginal-gain"),
        (rows(*[1.0] * 30), {"broad": True, "most": 20}, 12, "max-batches"),
        (rows(*[1.0] * 3), {"broad": True}, 3, "candidates-exhausted"),
        (rows(1.0, 0.9, concepts=["a"]), {"concepts": ["a"]}, 1, "coverage-satisfied"),
        (rows(1.0, 0.9, concepts=["b"]), {"concepts": ["a"]}, 0, "marginal-gain"),
        (rows(1.0, 0.8), {"concepts": ["a"]}, 1, "candidates-exhausted"),
    ],
)
def test_why_selection_ends(found, plan, taken, why):
    got, batches, evaluated, reason = h.select(found, PLAN | plan)
    assert (len(got), reason) == (taken, why) and batches <= 3 and evaluated <= len(found)


def test_tables_by_owner_are_not_sent_through_the_driver(spark, monkeypatch):
    from factloom.operators import tables

    monkeypatch.setattr(tables, "BROADCAST", 2)
    few, many = (tables.keyed(spark.range(n).withColumnRenamed("id", "owner"), "test") for n in (2, 3))
    other = spark.range(5).withColumnRenamed("id", "owner").repartition(2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan(other.join(few, "owner")) and "BroadcastExchange" not in plan(other.join(many, "owner"))
    dims = spark.sql("SELECT id AS owner, id, array(named_struct('dim', 1, 'sign', 1)) AS dims FROM range(3)")
    assert "BroadcastExchange" not in plan(h._weights(dims, "owner", "id").join(spark.range(3).withColumnRenamed("id", "owner"), "owner"))
