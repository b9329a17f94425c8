import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenia.llm import hard_negatives
from provenia.llm.hard_negatives import Best, cells, looked_up, mine, quantised, tables

KINDS = "vec_id long, embedding array<float>, label int, score string, codes string"


def brute(rows, positives=5, negatives=3, lower=50, upper=95):
    sound = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in sound:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, k) for j, k, w in sound if j != i)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [(t, j) for t, j, k in scored if k != lab and lower * -s <= 100 * -t <= upper * -s][:negatives]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def clustered(seed, n, dims, labels=4, spread=0.5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, n)
    x = (middle[label] * spread + rng.normal(size=(n, dims)) + 0.5).astype(np.float32)
    return [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], KINDS).repartition(3)
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % 50 == 0, **more).collect())


@pytest.mark.parametrize("dims", [1, 6, 7])
def test_matches_brute_force(spark, dims):
    rows = clustered(dims, 900, dims)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 20


def test_awkward_rows(spark):
    rows = clustered(3, 300, 5)
    rows += [(400 + i, [0.25] * 5, i % 2) for i in range(120)]  # ties
    rows += [(-50, [0.5, 0.5, 0.5, 0.5, 0.5], 0), (-100, [-1.0] * 5, 1), (None, [1.0] * 5, 0), (1000, None, 0), (1050, [1.0, None, 1.0, 1.0, 1.0], 0)]
    rows += [(1100, [float("nan")] * 5, 0), (1150, [float("inf")] * 5, 1), (1200, [0.5] * 5, None), (1250, [0.5, 0.5], 0), (1300, [], 1), (7, [0.3] * 5, 2), (7, [0.3] * 5, 2)]
    assert run(spark, rows) == brute(rows)


def test_repeated_anchors_repeat_their_results(spark):
    rows = clustered(4, 200, 4)
    got = run(spark, [*rows, rows[50]])
    assert got == brute([*rows, rows[50]])


def test_blocks_of_anchors(spark, monkeypatch):
    rows = clustered(5, 700, 4)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 16 * 3)
    monkeypatch.setattr(hard_negatives, "TABLES", 2)
    assert run(spark, rows) == brute(rows)


def test_other_parameters(spark):
    rows = clustered(6, 500, 6)
    assert run(spark, rows, positives=2, negatives=4, lower=10, upper=100) == brute(rows, 2, 4, 10, 100)


def test_empty(spark):
    empty = spark.createDataFrame([], KINDS)
    assert mine(empty, F.col("vec_id") % 50 == 0).collect() == []
    assert run(spark, [(1, [0.5], 1)]) == []
    assert run(spark, [(50, [0.5], 1)]) == []


def test_bounds_hold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(scale=80, size=(500, 8)).round().astype(int)
    df = spark.createDataFrame([(i, [float(v) / 256 for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    edges, *ends = cells(quantised(df))
    code = np.stack([np.searchsorted(edges[d], x[:, d], side="right") for d in range(8)], axis=1).astype(np.uint8)
    low, high = (looked_up(t, code[:, ::2] | code[:, 1::2] << 4) for t in tables(x[:40], *ends))
    exact = x @ x[:40].T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < np.ptp(exact) / 3  # and they say something


def test_best_keeps_ties_by_id():
    rng = random.Random(2)
    best, seen = Best(3, 4), []
    for _ in range(20):
        new = [(rng.randrange(3), rng.randrange(1000), rng.randrange(6)) for _ in range(10)]
        seen += new
        best.add(*(np.array(c) for c in zip(*new)))
    want = [(k, i, s) for k in range(3) for s, i in [(-a, b) for a, b in sorted((-s, i) for q, i, s in seen if q == k)[:4]]]
    assert list(zip(best.key.tolist(), best.id.tolist(), best.score.tolist())) == want
