import hashlib
import random
import re

import numpy as np

from factloom.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w and i is not None else []:
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                x = tuple(w[k : k + n])
                if len(x) == n and x in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_index_counts_and_locates_every_pattern():
    rng = np.random.default_rng(2)
    for _ in range(30):
        symbols = rng.integers(0, 4, rng.integers(1, 120))
        n = int(rng.integers(1, 5))
        index = d.FMIndex(symbols.astype("i8"), n, 3, sampled=4)
        if not index.stretches:
            continue
        patterns = rng.integers(1, 4, (20, n)).astype("i8")
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "délta", "e1", "f", "日本"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 14, 25]))) for i in range(12)] + [(12, None), (13, ""), (14, "!!"), (None, text(12)), (3, text(15))]
    docs = [(i, text(rng.randint(0, 40)) + " " + (items[rng.randrange(12)][1] if rng.random() < 0.5 else "")) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, items[1][1]), (62, items[2][1] * 40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(brute(docs, items), key=key)
    assert sorted(map(tuple, d.op7_decontamination(spark, str(tmp_path)).collect()), key=key) == want
    # in several blocks of phrases
    read = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    one = d.find_phrases(read("documents"), d.windows_of(read("benchmark"))).collect()
    more = d.find_phrases(read("documents"), d.windows_of(read("benchmark")), block=7).collect()
    assert sorted(map(str, one)) == sorted(map(str, more))


def test_cutting_leaves_no_window_and_keeps_clean_texts(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    windows = d.windows_of(bench)
    kept = d.remove_phrases(odd_docs, windows)
    assert kept.columns == odd_docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == "The\naway from it."
    assert texts[2] is None and texts[3] == "" and texts[5] == "!!! ??? ---" and len(texts[6]) > 100_000
    whole = spark.createDataFrame([(9, "Quick brown fox jumps over the lazy dog and runs!")], "doc_id long, text string")
    assert d.remove_phrases(whole, windows).count() == 0
    assert d.find_phrases(no_docs, windows).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_phrases(odd_docs, d.windows_of(none)).where("size(found.spans) > 0").count() == 0
