import random

import numpy as np
import pytest
from conftest import SF0001

from quarry.llm import ngram_join as nj
from quarry.llm.components import components


def brute(rows, n=4, least=85):
    """[(n_shingles, component_id)] per row by comparing all pairs of rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_gram = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    for j, s in enumerate(sets):
        for i in {i for g in s for i in by_gram[g] if i < j}:
            k = len(s & sets[i])
            if 100 * k >= least * (len(s) + len(sets[i]) - k) and find(i) != find(j):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(len(s), d if not s else ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, **kw).collect()), key=str)
    assert got == sorted(((d, *b) for (d, _), b in zip(rows, brute(rows, **kw))), key=str)


def near_copies(seed, groups=8, copies=12, words=60, vocabulary=400):
    """Groups with random edits, some of which reach each other only over others; and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(25)]
    rows = []
    for _ in range(groups):
        text = [word() for _ in range(rng.randint(3, words))] + passage * rng.randint(0, 2)
        for _ in range(copies):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                text = t  # drift
            if rng.random() < 0.3:
                t += [word() for _ in range(rng.randint(1, 8))]
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {}), (3, {"n": 1, "least": 60}), (4, {"n": 2, "least": 75})])
def test_random_groups_against_brute_force(spark, seed, kw):
    check(spark, near_copies(seed, vocabulary=40 if kw else 400), **kw)


def test_small_slices(spark, monkeypatch):
    monkeypatch.setattr(nj, "SLICE_SETS", 3)
    monkeypatch.setattr(nj, "COLUMNS", 7)
    check(spark, near_copies(5, copies=20))


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "one TWO"), (3, "one two three"), (2, "a b c d e f g h"), (1, "A b c d e f g h"), (1, "other words in this text here"),
            (4, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "x y z w"), (None, "x y z w"), (11, long), (12, long + " more"), (13, "x y z w v")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None)])


def test_threshold_is_exact(spark):
    words = [f"q{i}" for i in range(103)]  # 100 shingles
    for drop, together in ((14, True), (15, True), (16, False)):
        rows = [(1, " ".join(words)), (2, " ".join(words[drop:]))]
        assert (brute(rows)[1][1] == 1) == together
        check(spark, rows)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.op5_ngram_join(spark, SF0001).collect()}
    assert got == {d: b for (d, _), b in zip(rows, brute(rows))}
    assert any(d != c for d, (_, c) in got.items())


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_hashes_tell_words_apart_and_nothing_else():
    rng = random.Random(11)
    words = ["".join(rng.choices("abXYZé\u3000\x00\x1f", k=rng.randint(1, 6))) for _ in range(3000)] + ["w" * 5000, "a", "aa", "aaa"]
    blanks = [" ", "\n", "\t\t", "\x0b", "\x0c", "\r\n ", "  "]
    text = " " + "".join(w + rng.choice(blanks) for w in words)
    data = text.encode()
    want = data.lower().split()
    whole = nj.WordHashes().of(data)
    assert len(whole) == len(want) and len(set(zip(want, whole.tolist()))) == len(set(want)) == len(set(whole.tolist()))
    for piece in (1, 7, 64, 4096):
        assert (nj.WordHashes(piece).of(data) == whole).all()
    assert len(nj.WordHashes().of(b"")) == len(nj.WordHashes().of(b" \n ")) == 0


def test_prefixes_follow_one_order(spark):
    rng = np.random.default_rng(1)
    frequency = rng.integers(0, 9, 1 << nj.SKETCH_BITS)
    level = nj.rarity_levels(frequency)
    at = rng.integers(0, 1 << nj.SKETCH_BITS, 1000)
    a, b = np.meshgrid(at, at)
    assert (level[a] <= level[b])[frequency[a] < frequency[b]].all()
