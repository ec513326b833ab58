import random

import numpy as np
import pytest

from factloom.llm import near_duplicates as n


def classes_by_hand(rows):
    """Components of exact Jaccard 0.8 over sets of five words, and of equal texts."""
    sets = []
    for _, t in rows:
        w = [x.decode() for x in n.words_of(t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            a, b = sets[i], sets[j]
            if same or (a and b and len(a & b) / len(a | b) >= 0.8 - 1e-9):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(known) if known else None
    return out


def test_registers_agree_as_the_probability_jaccard():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(400)]
    other = list(base)
    for i in range(0, 400, 40):
        other[i] = "changed"
    texts = [" ".join(base), " ".join(other)]
    owner, hashed, counts = n.shingles(texts)
    weights = [dict(zip(hashed[owner == k].tolist(), (1 + np.log(counts[owner == k])).tolist(), strict=True)) for k in (0, 1)]
    jp = 0.0
    for x in weights[0].keys() & weights[1].keys():
        jp += 1 / sum(max(weights[0].get(y, 0) / weights[0][x], weights[1].get(y, 0) / weights[1][x]) for y in weights[0].keys() | weights[1].keys())
    who, _ = n.sketches(texts, 4000)
    assert abs((who[0] == who[1]).mean() - jp) < 0.03


def test_sketch_does_not_depend_on_company():
    texts = ["a b c d e f g", "", "one two", "a a a a a a a a"]
    together, worded = n.sketches(texts, 32)
    for i, t in enumerate(texts):
        alone, _ = n.sketches([t], 32)
        assert (alone[0] == together[i]).all()
    assert worded.tolist() == [True, False, True, True]


def make_rows(rng):
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 60, 120]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    rows += ["", "", "!!", "!!", None, None, "one", "one", "One!"]
    rng.shuffle(rows)
    return [(None if i == 5 else i, t) for i, t in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = make_rows(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = n.near_duplicate_classes(docs).collect()
    want = classes_by_hand(rows)
    assert len(got) == len(rows)
    assert {r.id: r.first_id for r in got if r.id is not None} == {rows[i][0]: c for i, c in want.items() if rows[i][0] is not None}


@pytest.mark.parametrize("pivots", [1, 3])
def test_crowded_bucket_in_tiles(spark, monkeypatch, pivots):
    """A crowd of texts around one another, dealt into tiles of a few."""
    monkeypatch.setattr(n, "TILE", 4)
    monkeypatch.setattr(n, "FAN", 5)
    monkeypatch.setattr(n, "PIVOTS", pivots)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = {r.id: r.first_id for r in n.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes_by_hand(rows)
    assert got == {rows[i][0]: c for i, c in want.items()}


def test_lines_that_repeat_very_differently_often(spark):
    """Pairs with one set of shingles, in which one text repeats three tenths of them 300 times."""
    rows = []
    for k in range(25):
        lines, rest = [f"c{k}x{i}" for i in range(60)], [f"d{k}x{i}" for i in range(140)]
        rows += [(2 * k + (times > 1), " ".join(lines * times + lines[:4] + rest)) for times in (1, 300)]
    got = {r.id: r.first_id for r in n.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(50)}


def test_joining_links_connect_what_is_connected():
    rng = random.Random(6)
    texts = []
    for _ in range(5):
        base = [f"v{rng.randrange(900)}" for _ in range(40)]
        texts += [" ".join(base[: 40 - k]) for k in range(0, 9, 2)]
    owner, hashed, _ = n.shingles(texts)
    sets = [hashed[owner == i].view("i8") for i in range(len(texts))]
    links = n.joining_links(sets, list(range(len(texts))), np.zeros(len(texts), "i8"), 0.8)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    want = classes_by_hand(list(enumerate(texts)))
    for i in range(len(texts)):
        for j in range(i):
            assert (root(i) == root(j)) == (want[i] == want[j])


def test_odd_documents(odd_docs, no_docs, spark, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = n.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, None, None, 8], key=str)
    assert n.near_duplicate_classes(no_docs).count() == 0


def test_survivors_do_not_depend_on_the_splits_of_a_later_scan(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i // 2} of a few words") for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    docs, classes = spark.read.parquet(str(tmp_path / "d")), n.near_duplicate_classes

    def splits_change(*args, **named):
        found = classes(*args, **named)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    monkeypatch.setattr(n, "near_duplicate_classes", splits_change)
    try:
        assert sorted(r.doc_id for r in n.drop_near_duplicates(docs).collect()) == list(range(0, 16, 2))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
