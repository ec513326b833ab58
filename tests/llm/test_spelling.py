import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import spelling as s

UPPER = str.maketrans(s.UPPER, s.LOWER)


def counts(rows, shortest=6, least=5, typo=199):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """Whether one inserted, deleted or replaced code point tells a from b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    others = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, found in others.items():
        top = min(found, key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(others[w]), words[form[w]] if form[w] else None))
    return out


def found(spark, words):
    return {tuple(r) for r in s.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_variants_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {}
    for _ in range(90):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 11)))
        for v in [w, *(w[:i] + rng.choice(["", *alphabet]) + w[i + rng.randint(0, 1) :] for i in (rng.randrange(len(w)) for _ in range(3)))]:
            if len(v) >= 6:
                words[v] = 5 * 6 ** rng.randint(0, 7) + rng.randint(0, 3)
    assert found(spark, words) == brute(words)


def test_long_chains_and_ties(spark):
    words = {"aaaaaa" + "b" * i: 5**i + 4 for i in range(20)} | {"zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25}
    words["aaaaaa"] = 5
    assert found(spark, words) == brute(words)
    assert {r[0]: r[1] for r in found(spark, words)}["zzzzzz"] == "zzzzzx"


def test_words_are_counted_in_whole_texts(spark, odd_docs, no_docs):
    rng = random.Random(2)
    vocabulary = ["Straße", "NAÏVETÉ", "naïveté", "abcdefg", "Abcdefg", "tables", "ﬁsches", "x×÷yzab", "short", "ünïcödé"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(vocabulary) + rng.choice(["", "1", "'s", "\n", "Ā"]) for _ in range(60))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, "longest " * 40_000), (3, "longest " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "run": F.lit("r"), "key": F.lit("k"), "h": F.lit(2)})
    assert {r.word: r.n for r in s.word_counts(df).collect()} == counts(rows)
    assert {r.word: r.n for r in s.word_counts(odd_docs).collect()} == counts([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert s.word_counts(no_docs).collect() == []
    assert found(spark, {"lonely": 5}) == {("lonely", None, "lonely", 5, 0, None)}
    assert s.variants(s.word_counts(no_docs)).collect() == []


def test_pivots_are_the_cheapest_disjoint_ones():
    rng = random.Random(8)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(1, 6)))
        costs = [rng.randint(1, 9) for _ in places]
        for parts in (2, 3):
            fits = [c for c in itertools.combinations(range(len(places)), parts) if all(places[b] - places[a] >= s.Q for a, b in itertools.pairwise(c))]
            got = s.pivots_of(places, costs, parts)
            if not fits:
                assert got == []
                continue
            least = min(sum(costs[i] for i in c) for c in fits)
            assert len(got) == parts and sum(costs[places.index(p)] for p in got) == least
            assert all(b - a >= s.Q for a, b in itertools.pairwise(got))


def test_a_prefix_always_has_two_disjoint_grams():
    rng = random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        order = {a + b: rng.random() for a in "abc" for b in "abc"}
        places, _ = s.prefix_of(word, order)
        assert len(s.pivots_of(places, [1] * len(places))) == 2
