import math

import numpy as np
import pytest

from quarry.llm import topk_search as ts


def brute(rows, k=5, every=50):
    long = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    clip = lambda c: max(-(1 << 62), min(1 << 62, c))
    ok = [(n, i, [clip(math.floor(256 * float(np.float32(c)))) for c in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for m, qi, q in ok:
        if qi % every:
            continue
        scores = [(long(sum(a * b for a, b in zip(q, c))), ci) for n, ci, c in ok if n != m and len(c) == len(q)]
        out += [(qi, r + 1, ci, s) for r, (s, ci) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    v = ts.scaled(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in ts.top_k(v, v.where("vec_id % 50 = 0"), **kw).collect())


@pytest.mark.parametrize("slice_bytes", [32 << 20, 1200])
def test_random_vectors_with_ties(spark, slice_bytes):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16)).round(2)
    rows = [(i, [float(c) for c in base[i % 40] * (1 + (i % 3 == 0))]) for i in range(400)]
    assert run(spark, rows, slice_bytes=slice_bytes) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (7, [0.1, 0.1]),
            (50, [1.0]), (100, [1.0, 0.5]), (100, [1.0, 0.5]), (None, [1.0, 1.0]), (8, [-1.0, -0.003]), (9, [3.0, 4.0, 5.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, [1.0])]) == [] and run(spark, []) == []


def test_repeated_ids_each_count(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (0, [0.0, 2.0])]
    got = run(spark, rows)
    assert got == brute(rows) and [r[2] for r in got if r[0] == 0].count(1) == 4


def test_large_components_are_exact(spark):
    rows = [(0, [600_000.0, 1.0]), (1, [256 / 256, 0.0]), (2, [600_000.0, 2.0]), (3, [524_288.0 * 8, 0.0])]
    assert run(spark, rows) == brute(rows) and (0, 3, 1, 39321600000) in run(spark, rows)
    huge = [(0, [1e30, 1.0]), (1, [1e30, -1e30]), (2, [1.0, 1e15]), (3, [-1e17, 1e12]), (50, [2e15, 3e15])]
    assert run(spark, huge) == brute(huge)
    long_ = [(i, [2.0**20] * 768) for i in range(3)]
    assert run(spark, long_) == brute(long_)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(5)
    for d in (1, 5, 64):
        x, q = rng.integers(-300, 300, (50, d)).astype(float), rng.integers(-300, 300, (3, d)).astype(float)
        exact, last = q @ x.T, np.inf
        for s in (1, 4, 16, 64):
            bound = ts.segment_statistics(q, s) @ ts.segment_statistics(x, s).T
            assert (bound >= exact - 1e-6).all()
            assert bound.mean() <= last + 1e-6
            last = bound.mean()
