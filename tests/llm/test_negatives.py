import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives as ng


def brute(rows, every=10, positives=5, per=5, low=80, high=100):
    """Multiset of (anchor, positive, rank, negative, positive score, negative score), pair by pair."""
    clip = lambda c: max(-(1 << 62), min(1 << 62, c))
    ok = [(n, i, lab, [clip(math.floor(256 * c)) for c in v]) for n, (i, v, lab) in enumerate(rows) if None not in (i, lab) and v and all(c is not None and math.isfinite(c) for c in v)]
    long = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    out = []
    for n, i, lab, x in ok:
        if i % every:
            continue
        others = [(-long(sum(a * b for a, b in zip(x, y))), j, m, l) for m, j, l, y in ok if m != n and len(y) == len(x)]
        others.sort(key=lambda o: o[:2])
        for s, j, _, l in [o for o in others if o[3] == lab][:positives]:
            p = -s
            inside = [o for o in others if o[3] != lab and low * p <= -100 * o[0] <= high * p][:per]
            out += [(i, j, r + 1, o[1], p, -o[0]) for r, o in enumerate(inside)]
    return sorted(out)


def run(spark, rows, every=10, partitions=3, **kw):
    df = spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, row int, x int").repartition(partitions)
    got = ng.mine(ng.scaled(df, "vec_id", "embedding", F.col("label")), F.col("vec_id") % every == 0, **kw)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("slice_bytes", [16 << 20, 900])
def test_random_vectors_with_ties(spark, slice_bytes):
    rng = np.random.default_rng(3)
    base = np.abs(rng.normal(size=(40, 19))).round(1)
    rows = [(i, [float(c) for c in base[i % 40]], int(rng.integers(0, 4))) for i in range(300)]
    want = brute(rows)
    assert want and run(spark, rows, slice_bytes=slice_bytes) == want


def test_signed_vectors_and_other_windows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=30)], i % 3) for i in range(250)]
    assert run(spark, rows) == brute(rows)
    kw = dict(positives=3, low=20, high=60)
    assert run(spark, rows, per_positive=2, **kw) == brute(rows, per=2, **kw) != []


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, [], 1), (None, [1.0, 1.0], 1), (6, [1.0, 0.5], None)]
    rows += [(7, [0.5, 0.5], 1), (7, [0.5, 0.5], 1), (8, [0.45, 0.5], 2), (8, [0.45, 0.5], 2), (9, [0.1, 0.0], 2), (10, [1.0], 1), (20, [0.0, 0.0], 3), (21, [0.0, 0.0], 3), (22, [-1.0, 0.0], 3), (30, [2.0, 2.0, 2.0], 5), (31, [1.0, 2.0, 1.0], 6)]
    want = brute(rows)
    assert want and run(spark, rows) == want
    assert run(spark, [(0, [1.0], 1)]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_scores_beyond_64_bits(spark):
    rows = [(0, [600_000.0] * 8, 1), (1, [600_000.0] * 8, 1), (2, [590_000.0] * 8, 2), (3, [1e15, 1.0] + [0.0] * 6, 1), (4, [-1e30] * 8, 2), (5, [2e13] * 8, 2), (6, [1e13] * 8, 1), (10, [1e4] * 8, 2)]
    want = brute(rows)
    assert any(abs(r[4]) < (1 << 62) for r in want) and run(spark, rows) == want


def test_hot_label_and_hot_vector(spark):
    rows = [(i, [0.3, 0.4, 0.5], 1 if i % 5 else 2) for i in range(600)] + [(1000 + i, [0.3, 0.4, 0.1 * i], 1) for i in range(5)]
    assert run(spark, rows, every=100) == brute(rows, every=100)


def test_scan_drops_candidates_before_the_last_column():
    """The bitmap shrinks on the way, and survivors hold exact scores."""
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (500, 64))
    x[:, :4] *= 40
    q = x[0].copy()
    data = ng.Columns(np.arange(500), np.arange(500), np.zeros(500, int), x)
    exact, seen = x @ q, []

    def keep(low, high):
        seen.append(len(low))
        return high >= np.partition(exact, -5)[-5]

    alive, scores = ng.vertical_scan(q, data, np.arange(500), keep)
    assert set(np.argsort(-exact)[:5]) <= set(alive.tolist()) and (scores == exact[alive]).all()
    assert len(alive) < 50 and seen[1] < 500 and seen == sorted(seen, reverse=True)


def test_registered_query_changes_labels_first(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = ng.op13_hard_negatives(spark, sf)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(rows, every=100) != []
