"""Literals, UTF-16 spans and alias decisions on planted rows."""

from pyspark.sql import functions as F

from factloom.functions import literals
from factloom.operators import gates


def test_amounts(spark):
    rows = spark.createDataFrame(
        [("¥1,200.5", None), ("€ 3", "usd"), ("12 亿元", None), ("7", None), ("5 欧元", None), ("1e3", None), ("", None), (None, None), ("9" * 400 + "元", None)], "t string, u string"
    )
    got = [r.a and tuple(r.a) for r in rows.select(literals.amount("t", F.col("u"), F.lit(False)).alias("a")).collect()]
    assert got == [(1200.5, "CNY"), None, (12.0, "亿元"), (7.0, None), (5.0, "EUR"), None, None, None, None]
    needed = [r.a and tuple(r.a) for r in rows.select(literals.amount("t", F.col("u"), F.lit(True)).alias("a")).collect()]
    assert needed[3] is None and needed[4] == (5.0, "EUR")


def test_dates_and_booleans(spark):
    rows = spark.createDataFrame([("2024-02-29",), ("2023-2-29",), ("2024年3月5日",), ("0050-01-01",), ("是",), (None,)], "t string")
    got = rows.select(literals.calendar_date("t").alias("d"), literals.boolean("t").alias("b")).collect()
    assert [r.d for r in got] == ["2024-02-29", None, "2024-03-05", None, None, None]
    assert [r.b for r in got] == [None, None, None, None, True, None]


def test_utf16_slices_do_not_split_pairs(spark):
    s = "a😀bé漢😀"
    places = [(i, j) for i in range(-1, 10) for j in range(0, 10)]
    rows = spark.createDataFrame([(s, i, j) for i, j in places], "t string, i int, j int")
    got = [r.x for r in rows.select(literals.utf16_slice("t", F.col("i"), F.col("j")).alias("x")).collect()]
    units = s.encode("utf-16-be")

    def plain(i, j):
        if not 0 <= i < j <= len(units) // 2 or any(units[2 * k : 2 * k + 1] and 0xDC <= units[2 * k] <= 0xDF for k in (i, j)):
            return None
        return units[2 * i : 2 * j].decode("utf-16-be")

    assert got == [plain(i, j) for i, j in places]
    at = rows.limit(1).select(*(literals.utf16_offset("t", F.lit(n)).alias(str(n)) for n in range(7))).first()
    assert list(at) == [0, 1, 3, 4, 5, 6, 8]


def test_last_decision_of_a_member_holds(spark):
    entities = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "entity_id int")
    decisions = spark.createDataFrame(
        [(1, 2, "merge", "accepted", 1, 1), (1, 3, "merge", "accepted", 2, 2), (1, 4, "merge", "rejected", 3, 3), (2, 3, "merge", "accepted", 1, 4), (2, 3, "split", "accepted", 2, 5), (4, 9, "merge", "accepted", 1, 6)],
        "member int, canonical int, action string, status string, recorded_at int, decision_id int",
    )
    assert [tuple(r) for r in gates.canonical_members(decisions, entities).collect()] == [(1, 3)]


def test_spans_by_reason(spark):
    episodes = spark.createDataFrame([(1, "x😀yz", "h", "open", "normal"), (2, "abc", "h", "never", "normal"), (3, None, "h", "open", "normal")], "episode_id int, content string, content_hash string, share string, sensitivity string")
    refs = spark.createDataFrame([(1, 1, "h", 1, 4), (2, 1, "h", 2, 4), (3, 1, "g", 0, 1), (4, 2, "h", 0, 1), (5, 3, "h", 0, 1), (6, 9, "h", 0, 1)], "ref_id int, episode_id int, content_hash string, start int, end int")
    got = {r.ref_id: (r.span, r.reason) for r in gates.exact_spans(refs, episodes, ["open"], ["normal"]).collect()}
    assert got == {1: ("😀y", None), 2: (None, "span"), 3: (None, "changed"), 4: (None, "withheld"), 5: (None, "missing"), 6: (None, "missing")}


def test_hot_message_offers_what_a_query_can_use(spark):
    links = spark.createDataFrame([(7, f) for f in range(500)] + [(8, 3), (8, 900)], "episode_id int, fact_id int")
    seeds = spark.createDataFrame([(1, f) for f in range(12)] + [(2, 900)], "query_id int, fact_id int")
    got = gates.sharing_messages(seeds, links, 60, 12).collect()
    assert sorted(r.fact_id for r in got if r.query_id == 1) == list(range(12, 72)) and [r.fact_id for r in got if r.query_id == 2] == [3]


def test_leaks_are_asked_of_words_not_of_pairs(spark):
    from core_helpers import SF
    from factloom.plans import gates as plans

    plan = plans.safety_leaks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(w#" not in plan


def test_retrieval_rows_lists_a_fact_once_that_the_mapping_repeats(spark):
    hits = spark.createDataFrame([(1, "a", 1, 20), (1, "a", 2, 10), (2, "b", 1, 10), (3, "c", 1, 99)], "query_id long, text string, rank int, id long")
    mapping = spark.createDataFrame([(10, 10), (20, 20), (10, 10), (20, 20)], "id long, fact_id long")
    assert {r.query_id: r.fact_ids for r in gates.retrieval_rows(hits, mapping, "text").collect()} == {1: [20, 10], 2: [10]}
