import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import topk_search as t


def brute(rows, k=5):
    fine = [(i, r, [math.floor(256 * x) for x in v]) for r, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, r, v in fine:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, s, w in fine if s != r and len(w) == len(v)), key=lambda x: (x[0], x[1] if x[1] is not None else -1))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted((tuple(r) for r in t.top_k(df, F.col("vec_id") % 50 == 0, k=k).collect()), key=str)


def f32(rng, d):
    return [float(np.float32(rng.gauss(0, 0.3))) for _ in range(d)]


def test_equal_to_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(3)
    common = f32(rng, 8)
    rows = [(i, f32(rng, 8) if i % 3 else common) for i in range(260)]
    rows += [(300, None), (301, []), (350, [float("nan")] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("inf")] + [0.0] * 7), (400, f32(rng, 3)), (401, f32(rng, 3))]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_and_few_candidates(spark):
    rows = [(0, [0.5, 0.5]), (0, [0.25, 0.5]), (1, [0.1, 0.2])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, []) == []


def test_large_finite_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, f32(rng, 4)) for i in range(120)]
    rows += [(150, [1e9, -1e9, 3.0, 0.5]), (151, [1e9, 1e9, 1.0, 0.0]), (152, [3e38, -3e38, 1.0, 0.0]), (200, [-3e38, 3e38, 2.0, 1.0]), (201, [3e38, 3e38, 1e9, 1.0])]
    clipped = [(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows])]
    assert run(spark, rows) == sorted(clipped, key=str)


def test_pruning_in_small_steps_is_exact(monkeypatch):
    monkeypatch.setattr(t, "SEED", 16)
    rng = np.random.default_rng(7)
    columns = rng.integers(-200, 200, (40, 500)) * (rng.random((1, 500)) ** 3 * 4).astype("i8")
    queries = np.concatenate([columns[:, :20].T, rng.integers(-200, 200, (10, 40))])
    own = np.concatenate([np.arange(20), np.full(10, -1)])
    got = {}
    for q, p, s in t.best_of_block(queries, own, np.arange(500), columns, 5, width=8, step=32):
        for a, b, c in zip(q, p, s, strict=True):
            got.setdefault(int(a), []).append((int(b), int(c)))
    for q in range(30):
        full = queries[q] @ columns
        order = [int(p) for p in np.lexsort((np.arange(500), -full)) if p != own[q]][:5]
        assert got[q] == [(p, int(full[p])) for p in order]
