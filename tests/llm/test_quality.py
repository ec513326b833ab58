import math
import random

import numpy as np

from factloom.llm import quality as q
from llm_helpers import auc


def corpus(rng, n):
    good, bad = [f"word{i}" for i in range(200)], ["BUY", "NOW", "!!!", "CLICK", "$$$"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        words = [rng.choice(good) for _ in range(30)]
        if not y:
            for _ in range(6):
                words.insert(rng.randrange(30), rng.choice(bad))
        rows.append((i, " ".join(words), y))
    return rows


def test_features_are_unit_length_and_hold_words_and_pairs():
    bounds, buckets, values = q.features(["a b a b", "", "x"])
    assert np.diff(bounds).tolist() == [4, 0, 1]
    assert np.isclose((values[:4] ** 2).sum(), 1) and values[4] == 1
    again = q.features(["x"])
    assert again[1].tolist() == buckets[4:].tolist()


def test_held_out_accuracy_and_held_out_labels_are_unused(spark, tmp_path):
    rng = random.Random(1)
    rows = corpus(rng, 600)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in q.op8_quality_classifier(spark, str(tmp_path)).collect()}
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert 80 < len(held) < 160 and auc(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    from factloom.llm.common import held_out

    flipped = labels.selectExpr("doc_id", "quality").withColumn("h", held_out("doc_id")).selectExpr("doc_id", "if(h, 1 - quality, quality) quality")
    a, b = q.train_quality(docs, labels), q.train_quality(docs, flipped)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_fit_and_scores_equal_a_plain_version():
    """FTRL-proximal written out for one coordinate at a time, on dictionaries."""
    rows = corpus(random.Random(5), 60)
    bits, alpha, beta, l1, l2, epochs = 12, 2.0, 1.0, 0.02, 0.001, 2
    bounds, buckets, values = q.features([t for _, t, _ in rows], bits)
    data = [(buckets[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]], y) for i, (_, _, y) in enumerate(rows)]
    model = q.fit_ftrl(data, bits, alpha, beta, l1, l2, epochs)
    z, n, ones = {}, {}, sum(y for _, _, y in rows)
    bias, bias_n = math.log((ones + 0.5) / (len(rows) - ones + 0.5)), 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for idx, x, y in data:
            pairs = [(int(i), float(v)) for i, v in zip(idx, x)]
            w = {i: weight(i) for i, _ in pairs}
            g = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in pairs) + bias))) - y
            for i, v in pairs:
                sigma = (math.sqrt(n.get(i, 0.0) + (g * v) ** 2) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g * v - sigma * w[i]
                n[i] = n.get(i, 0.0) + (g * v) ** 2
            bias_n += g * g
            bias -= 0.1 * alpha / (beta + math.sqrt(bias_n)) * g
    assert abs(model.bias - bias) < 1e-9
    assert all(abs(model.weights[i] - weight(i)) < 1e-5 for i in range(1 << bits))
    scores = model.scores([t for _, t, _ in rows])
    for (idx, x, _), s in zip(data, scores):
        plain = 1 / (1 + math.exp(-(sum(weight(int(i)) * float(v) for i, v in zip(idx, x)) + bias)))
        assert abs(plain - s) < 1e-5


def test_a_key_with_many_rows_keeps_to_the_bound(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 2, "doc_id long, quality int")
    seen = []
    fit, q.fit_ftrl = q.fit_ftrl, lambda rows, bits: seen.append(len(rows)) or fit(rows, bits)
    try:
        q.train_quality(docs, labels, train_rows=4)
    finally:
        q.fit_ftrl = fit
    assert seen == [4]


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (6, 0), (8, 1), (None, 1)], "doc_id long, quality int")
    model = q.train_quality(odd_docs, labels)
    rows = q.score_quality(odd_docs, model).collect()  # the clashing score column is replaced
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    none = q.train_quality(no_docs, labels.where("false"))
    assert q.score_quality(odd_docs, none).where("score <> 0.5").count() == 0
    assert q.score_quality(no_docs, model).count() == 0
