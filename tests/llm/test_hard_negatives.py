import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hard_negatives as h

TOP, BOTTOM = 2**63 - 1, -(2**63)


def brute(rows, positives=5, negatives=3):
    fine = [(i, r, y, [math.floor(Fraction(256) * Fraction(x)) for x in v]) for r, (i, v, y) in enumerate(rows) if y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2])
    clip = lambda s: max(BOTTOM, min(TOP, s))
    out = []
    for i, r, y, v in fine:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, s, z) for j, s, z, w in fine if s != r and len(w) == len(v)]
        for p in sorted((x for x in scored if x[3] == y), key=order)[:positives]:
            fit = sorted((x for x in scored if x[3] != y and 50 * p[0] <= 100 * x[0] <= 95 * p[0]), key=order)[:negatives]
            out += [(i, p[1], k + 1, x[1], clip(p[0]), clip(x[0])) for k, x in enumerate(fit)]
    return Counter(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit("clash") for n in ("row", "leaf", "score", "a", "copy", "rank")})
    return Counter(tuple(r) for r in h.mine(df, F.col("vec_id") % 50 == 0).collect())


def f32(rng, d, at=0.0, width=0.3):
    return [float(np.float32(rng.gauss(at, width))) for _ in range(d)]


def test_equal_to_brute_force_over_a_tree(spark, monkeypatch):
    monkeypatch.setattr(h, "LEAF", 20)
    rng = random.Random(1)
    hubs = [f32(rng, 6, width=1.0) for _ in range(12)]
    rows = []
    for i in range(900):
        hub = rng.randrange(12)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in hubs[hub]], hub % 4 if rng.random() < 0.8 else rng.randrange(4)))
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want


def test_copies_ties_odd_vectors_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(h, "TILE", 16)
    monkeypatch.setattr(h, "BLOCK", 2)
    rng = random.Random(3)
    common = f32(rng, 5)
    rows = [(i, common if i % 3 == 0 else f32(rng, 5), i % 2 if i % 11 else None) for i in range(260)]
    rows += [(0, common, 1), (0, common, 1), (None, common, 0), (None, common, 0), (1, common, 1)]
    rows += [(300, None, 1), (301, [], 1), (350, [float("nan")] * 5, 0), (302, [1.0, None, 0.0, 0.0, 0.0], 0), (303, [float("inf")] * 5, 1), (400, f32(rng, 3, 1.0), 0), (401, f32(rng, 3, 1.0), 0), (402, f32(rng, 3, 0.7), 1), (450, [0.0] * 5, 1)]
    assert run(spark, rows) == brute(rows)


def test_large_finite_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, f32(rng, 4), i % 2) for i in range(80)]
    rows += [(150, [1e9, -1e9, 3.0, 0.5], 0), (151, [1e9, -1e9, 1.0, 0.0], 0), (152, [8e8, -7e8, 1.0, 0.0], 1), (200, [-3e38, 3e38, 2.0, 1.0], 1), (201, [-3e38, 2e38, 1e9, 1.0], 1), (202, [-2e38, 2e38, 1e9, 1.0], 0)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.25, 0.5], 1), (2, [0.2, 0.4], 2)]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 1
    assert run(spark, [(50, [1.0], 0)]) == Counter()
    assert run(spark, []) == Counter()


@pytest.mark.parametrize("score", [0, 1, -1, 7, 100, 65_537, -3, 10**40 + 7])
def test_windows_hold_the_same_scores_as_the_inequality(score):
    a, b = h.window(score, 50, 95)
    for s in [a - 1, a, b, b + 1, score, 0]:
        assert (a <= s <= b) == (50 * score <= 100 * s <= 95 * score)


def test_ranges_leave_subtrees_out_but_no_row_of_an_annulus():
    rng = np.random.default_rng(4)
    hubs = rng.normal(0, 60, (40, 8))
    rows = np.floor(hubs[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 8)))
    norm2 = float((rows**2).sum(1).max())
    tree = h.grown(rows[:1500], norm2, 2)
    lifted = tree.lifted(rows)
    tree.ranges = {n: np.stack([np.full((len(p),) * 2, np.inf), np.full((len(p),) * 2, -np.inf)], -1) for n, p in tree.points.items()}
    for node, _, far, near in tree.down(lifted):
        for j in np.unique(near):
            tree.ranges[node][:, j, 0] = np.minimum(tree.ranges[node][:, j, 0], far[near == j].min(0))
            tree.ranges[node][:, j, 1] = np.maximum(tree.ranges[node][:, j, 1], far[near == j].max(0))
    leaf = tree.leaves(lifted)
    anchors = np.hstack([rows[:60], np.zeros((60, 1))])
    far = h.distances(anchors, lifted)
    inner, outer = np.quantile(far, 0.002, axis=1)[:, None], np.quantile(far, 0.02, axis=1)[:, None]
    visited = np.zeros((60, leaf.max() + 1), bool)
    for one, places in tree.meeting(anchors, inner, outer):
        visited[places, one] = True
    inside = (far >= inner) & (far <= outer)
    assert all(visited[i, leaf[inside[i]]].all() for i in range(60))
    assert visited.sum() < 0.5 * 60 * len(np.unique(leaf))
