"""Nested model output of any shape."""

import json

from core_helpers import SF
from factloom.operators import model_output as m
from factloom.plans import model_output as plans

TEXT = "\U0001f600鲁迅住在北京"
ENTRY = lambda text, start, end, p, **more: {"text": text, "start": start, "end": end, "probability": p, **more}
GOOD = {
    "人物": [
        ENTRY("鲁迅", 1, 3, 0.8, relations={"居住地": [ENTRY("北京", 5, 7, 0.9), ENTRY("北京", 5, 7, 0.7)], "成立日期": [ENTRY("北京", 5, 7, 1)], " ": [ENTRY("北京", 5, 7, 1)], "作者": "no"}),
        ENTRY("鲁迅", 1, 3, 0.6), ENTRY("鲁迅", 1.0, 3, 0.5), ENTRY("鲁迅", 0, 2, 0.9), ENTRY("鲁迅", "1", 3, 0.9), ENTRY("鲁迅", 1, 3, 1.5), ENTRY("鲁迅", 1.5, 3, 0.9), ENTRY("鲁迅", -1, 3, 0.9), ENTRY("鲁迅", 1, 99, 0.9),
        ENTRY(5, 1, 3, 0.9), None, 7, [], {},
    ],
    "姓名": [ENTRY("鲁迅", 1, 3, 0.4)], "自定": [ENTRY("住", 3, 4, 0.9)], "地点": "no list",
}
PAYLOADS = [json.dumps(GOOD), '{"人物": [', "[1]", None, "{}", '"text"', json.dumps({"人物": {"text": "x"}})]


def rows(spark):
    return spark.createDataFrame([(i, TEXT if i != 4 else None, p) for i, p in enumerate(PAYLOADS)], "id long, t string, p string")


def test_rejects(spark):
    assert {r.id: r.reason for r in m.rejects(rows(spark), "id", "p").collect()} == {1: "malformed", 2: "not-an-object", 3: "malformed", 5: "not-an-object"}


def test_mentions_and_relations(spark):
    df = rows(spark)
    found = {(r.id, r.label, r.role, r.text, r.start, r.end, r.score) for r in m.mentions(df, "id", "t", "p").collect()}
    assert found == {(0, "人物", "entity", "鲁迅", 1, 3, 0.8), (0, "姓名", "field", "鲁迅", 1, 3, 0.4)}
    rels = m.relations(df, "id", "t", "p")
    assert {(r.predicate, r.subject.text, r.object.text, r.score) for r in rels.collect()} == {("居住地", "鲁迅", "北京", 0.8), ("成立日期", "鲁迅", "北京", 0.8)}
    facts = {r.predicate: (r.subject, r.object, r.literal, r.value_type, r.start, r.end) for r in m.run_facts(rels, df, "id", "t").collect()}
    assert facts == {"居住地": ("1:3", "5:7", None, None, 2, 8), "成立日期": ("1:3", None, "北京", "date", 2, 8)}
    ents = {(r.start, r.end, r.type, r.text) for r in m.run_entities(m.mentions(df, "id", "t", "p"), rels, "id").collect()}
    assert ents == {(1, 3, "person", "鲁迅"), (5, 7, "location", "北京")}


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, t string, p string")
    assert m.mentions(none, "id", "t", "p").count() == m.relations(none, "id", "t", "p").count() == m.rejects(none, "id", "p").count() == 0


def test_words_of_payloads_are_read_once(spark):
    plan = plans.output_rejects(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2  # one for each word; with a filter on the reason they stood 78 times in the plan
