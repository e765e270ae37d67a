import math

import numpy as np
import pytest

from quarry.llm import whitening as wh


def plain(rows, k=16):
    """vec_id -> list of (component, n, deviation, whitened, explained), by numpy's own eigensolver on exact sums."""
    ok = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace, k = values.sum(), min(k, int((values > 1e-12 * values[0]).sum()))
    out = []
    for i, x in ok:
        z = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors[:, :k] / np.sqrt(values[:k])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out.append((i, n, deviation, z, values[:k] / trace))
    return out


def run(spark, rows, partitions=3, kind="float", k=16):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, whitened string").repartition(partitions)
    x = wh.scaled(df, "vec_id", "embedding")
    return wh.whiten(x, wh.fit(x, k)).collect()


def agree(got, want, tolerance=1e-8):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert sum(len(v) for c in by.values() for v in c.values()) == sum(len(w[3]) for w in want)
    reference = max(want, key=lambda w: np.abs(w[3]).min())
    signs = [np.sign(reference[3][c] * by[reference[0]][c + 1][0].whitened) for c in range(len(reference[3]))]
    for i, n, deviation, z, explained in want:
        for c in range(len(z)):
            r = by[i][c + 1][0]
            assert r.n == n and int(r.deviation) == deviation
            assert abs(r.whitened * signs[c] - z[c]) < tolerance * max(1.0, abs(z[c])) and abs(r.explained / explained[c] - 1) < 1e-9
    assert len({len(c) for c in by.values()}) == 1


def test_random_vectors_repeats_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(150, 24)) * np.linspace(3, 0.3, 24)).astype(np.float32)
    rows = [(i, [float(c) for c in base[i % 150]]) for i in range(400)]
    rows += [(900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] * 24), (905, [1.0, 2.0])]
    good = rows[:400]
    got = run(spark, rows)
    agree(got, plain(good))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    z = np.zeros((400, 16))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(z[:150].T, bias=True) - np.eye(16)).max() < 1e-9


def test_large_offsets_keep_their_digits(spark):
    """Entries of 1e9 that differ by little: centring before multiplying keeps them apart."""
    rng = np.random.default_rng(6)
    rows = [(i, [1e9 + float(c) for c in rng.integers(0, 64, 6) / 64]) for i in range(200)]
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in ok})
    m = np.array([[c - fit[0][j] for j, c in enumerate(x)] for x in fit], float)
    want = np.linalg.eigvalsh(np.cov(m.T, bias=True))[::-1]
    got = run(spark, rows, kind="double")
    assert np.allclose([r.explained for r in got if r.vec_id == 0], want / want.sum(), rtol=1e-9) and got[0].identity_error < 1e-8
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in ok}
    assert all(int(r.deviation) == exact[r.vec_id] for r in got)


def test_few_dimensions_low_rank_and_nothing_to_whiten(spark):
    assert {r.component for r in run(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 7.0])])} == {1, 2}
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # one direction only
    got = run(spark, flat)
    assert {r.component for r in got} == {1} and len(got) == 10
    agree(got, plain(flat))
    assert run(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0])]) == [] and run(spark, []) == [] and run(spark, [(1, None)]) == []
    twice = run(spark, [(1, [1.0]), (1, [1.0]), (None, [2.0])], partitions=1)
    assert sorted((r.vec_id or 0, round(abs(r.whitened), 9)) for r in twice) == [(0, 1.0), (1, 1.0), (1, 1.0)]


def test_huge_entries(spark):
    rows = [(1, [2.0**60, 0.0]), (2, [1.0, 3.0]), (3, [2.0, 1.0]), (4, [4.0, 9.0])]  # the first leaves a long once scaled
    assert {r.vec_id for r in run(spark, rows, kind="double")} == {2, 3, 4}
    wide = run(spark, [(1, [2.0**50, 0.0]), (2, [-(2.0**50), 3.0])], kind="double")
    assert {int(r.deviation) for r in wide} == {2**114 + 192**2}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_eigenpairs(size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    spectra = [rng.random(size), np.ones(size), np.repeat([3.0, 2.0], [size - size // 2, size // 2]), 10.0 ** -np.arange(size), 5 + 1e-10 * np.arange(size)]
    for spectrum in spectra:
        for v in (q @ np.diag(spectrum) @ q.T, np.diag(spectrum)):
            v = (v + v.T) / 2
            values, vectors = wh.leading_eigenpairs(v, 16)
            assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:16]).max() < 1e-13 * spectrum.max()
            assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * spectrum.max()
            assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_sturm_counts():
    rng = np.random.default_rng(9)
    d, e = rng.normal(size=30), rng.normal(size=29)
    e[[4, 11]] = 0.0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    points = np.concatenate([values - 1e-9, values + 1e-9])
    assert (wh.below(d, e, points) == [(values < p).sum() for p in points]).all()


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    out = wh.op12_whitening(spark, sf)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    agree(out.collect(), plain([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]))
