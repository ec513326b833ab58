"""Maintenance jobs against brute force, on what the given tables don't hold."""

from itertools import combinations

from factloom.functions import text
from factloom.operators import maintenance


def pairs_by_hand(rows, least=0.5):
    """Pairs of a source that share one of their three rarest tokens, with the Jaccard of their words."""
    sets = {i: (s, set((t or "").split())) for i, s, t in rows}
    df = {}
    for s, words in sets.values():
        for w in words:
            df[s, w] = df.get((s, w), 0) + 1
    keys = {i: {w for _, w in sorted((df[s, w], w) for w in words if df[s, w] > 1)[:3]} for i, (s, words) in sets.items()}
    out = {}
    for a, b in combinations(sorted(sets), 2):
        (sa, wa), (sb, wb) = sets[a], sets[b]
        if sa == sb and sa is not None and keys[a] & keys[b] and round(len(wa & wb) / len(wa | wb), 6) >= least:
            out[a, b] = (sa, round(len(wa & wb) / len(wa | wb), 6))
    return out


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = maintenance.rare_token_pairs(docs, "doc_id", "source", text.word_tokens("text"), 0.5).collect()
    out = {(r.a, r.b): (r.source, r.jaccard) for r in found}
    assert len(out) == len(found)
    return out


def test_rare_token_pairs_of_more_than_500_copies(spark):
    rows = [(i, "s", "red green blue black" if i % 2 else "black blue green red red") for i in range(520)]
    rows += [(1000 + i, "s", f"red green blue own{i}") for i in range(3)] + [(2000, "s", "far away"), (2001, "s", None), (2002, None, "red green blue black"), (2003, "t", "red green blue black")]
    want = pairs_by_hand(rows)
    assert len(want) >= 520 * 519 // 2
    assert got(spark, rows) == want


def test_rare_token_pairs_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "TILE", 4)
    rows = [(i, "st"[i % 5 == 0], " ".join(f"w{(i * 7 + k * (1 + i % 3)) % 13}" for k in range(6))) for i in range(60)]
    rows += [(100 + i, "s", "same words here") for i in range(15)]
    assert got(spark, rows) == pairs_by_hand(rows)


def test_rare_token_pairs_with_more_frequencies_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "TILE", 4)
    monkeypatch.setattr(maintenance, "BROADCAST", 3, raising=False)
    # some have three tokens that aren't common, some have common ones alone, some fewer than three in all
    rows = [(i, "st"[i % 4 == 0], f"all of a kind k{i % 9} m{i % 7} n{i % 5} own{i}" if i % 3 else "all of a kind" if i % 2 else "of kind") for i in range(70)]
    rows += [(100, "s", ""), (101, "s", None), (102, None, "all of a kind"), (103, "u", "alone here"), (104, "s", "k1 m1")]
    want = pairs_by_hand(rows)
    assert len(want) > 100 and got(spark, rows) == want


def test_rare_token_pairs_make_tokens_once(spark):
    docs = spark.createDataFrame([(1, "s", "red green blue"), (2, "s", "red green black"), (3, "s", "red green blue")], "doc_id long, source string, text string")
    found = maintenance.rare_token_pairs(docs, "doc_id", "source", text.word_tokens("text"), 0.5)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 3


def test_mirror_and_its_sql_agree_on_orders_that_tie(spark, tmp_path):
    import duckdb

    from factloom.plans import stores

    # one customer's orders of one time: numbers that end alike tie, and 98... is the last as text, not the largest
    rows = [(1, 2007, "O"), (1, 98007, "F"), (1, 150007, "O"), (2, 1007, "O"), (2, 2007, "P"), (2, 3007, "P"), (3, 5, "O")]
    df = spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string").selectExpr("*", "o_orderkey * 1.5D AS o_totalprice", "TIMESTAMP '2000-01-01' AS o_orderdate")
    df.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.key, r.order_id) for r in stores.mirror_batches(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for order in ("o_orderkey", "o_orderkey DESC"):
        con.sql(f"CREATE OR REPLACE TABLE orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' ORDER BY {order}")
        assert sorted((r[0], r[2]) for r in con.sql(stores.MIRROR_BATCHES).fetchall()) == got == [(1, 98007), (3, 5)]
