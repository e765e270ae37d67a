import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF0001

from quarry.llm import suffix_dedup as sd


def brute(texts, length):
    """[(n_bytes, merged removed ranges)] by counting every string of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    return [(len(d), sd.merged([(i, i + length) for i in range(len(d) - length + 1) if n[d[i : i + length]] > 1])) for d in data]


def run(spark, rows, shape):
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int")
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.spans, bytes(r.kept)) for r in sd.remove_repeats(df, shape).collect())


def wanted(rows, length):
    out = []
    for (i, t), (n, cut) in zip(rows, brute([t for _, t in rows], length)):
        data = (t or "").encode()
        kept = b"".join(data[k : k + 1] for k in range(n) if not any(a <= k < b for a, b in cut))
        out.append((i is not None, i or 0, n, [x for c in cut for x in c], kept))
    return sorted(out)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abé", k=k))
    shared = [word(rng.randint(6, 40)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([word(rng.randint(0, 12)), rng.choice(shared), "ab" * rng.randint(0, 9)]) for _ in range(rng.randint(0, 8)))) for i in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (2, rows[2][1]), (None, rows[4][1]), (None, "zz" * 30)]


@pytest.mark.parametrize("seed,shape", [(1, sd.Shape(12, 7)), (2, sd.Shape(16, 5)), (3, sd.Shape(10, 9)), (4, sd.Shape(14, 8, most=3)), (5, sd.Shape(20, 6, most=1))])
def test_random_texts_against_brute_force(spark, seed, shape):
    rows = random_rows(seed)
    assert run(spark, rows, shape) == wanted(rows, shape.length)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(8)
    data = np.array(rng.choices(b"ab", k=5000), np.uint8)
    shape = sd.Shape(20, 12)
    whole = sd.anchors_of(data, shape, sd.Powers())
    monkeypatch.setattr(sd, "PIECE", 333)
    cut = sd.anchors_of(data, shape, sd.Powers())
    # a piece may add anchors at its edges (a window cut short), never lose one
    assert set(whole[0].tolist()) <= set(cut[0].tolist())


def test_every_window_has_an_anchor_that_depends_on_its_bytes_only():
    rng = random.Random(9)
    shape = sd.Shape(30, 12)
    core = rng.choices(b"abc", k=30)
    place = set()
    for _ in range(20):
        data = np.array(rng.choices(b"abc", k=50) + core + rng.choices(b"abc", k=50), np.uint8)
        at, _ = sd.anchors_of(data, shape, sd.Powers())
        place.add(frozenset(int(p) - 50 for p in at if 50 <= p <= 50 + 18))
    assert frozenset.intersection(*place)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: b for r, b in zip(docs, brute([r.text for r in docs], 400))}
    texts = {r.doc_id: r.text.encode() for r in docs}
    got = sd.op9_suffix_dedup(spark, SF0001).collect()
    assert len(got) == len(want) and any(r.n_removed for r in got)
    for r in got:
        n, cut = want[r.doc_id]
        d = texts[r.doc_id]
        kept = b"".join(d[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), n]))
        assert (r.n_bytes, r.n_spans, r.n_removed, r.kept_sha256) == (n, len(cut), n - len(kept), hashlib.sha256(kept).hexdigest())


def test_planted_passages_show_in_n_removed_and_not_in_n_bytes(spark, tmp_path):
    """Passages of over 50 words: those of 400 bytes go, shorter ones stay, clean texts stay whole."""
    rng = random.Random(12)
    words = lambda n, least, most: " ".join("".join(rng.choices("abcdefgéü", k=rng.randint(least, most))) for _ in range(n))
    long, short = words(60, 7, 9), words(55, 3, 5)
    assert len(long.encode()) >= 400 > len(short.encode())
    planted = {i: long if i % 4 == 1 else short if i % 4 == 2 else "" for i in range(40)}
    around = {i: (words(rng.randint(0, 90), 2, 8) + chr(65 + i), chr(65 + i) + words(rng.randint(0, 90), 2, 8)) for i in planted}  # no two agree beside the passage
    rows = [(i, p.join(around[i])) for i, p in planted.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sd.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, text in rows:
        cut, n = planted[i] == long, len(text.encode())
        kept = ("".join(around[i]) if cut else text).encode()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, n - len(kept), int(cut), hashlib.sha256(kept).hexdigest())


def test_repeat_groups_hold_all_occurrences(spark):
    rows = [(i, f"{i:02d}" * 9 + "the shared passage of text" + f"{9 - i}" * 8) for i in range(5)]
    shape = sd.Shape(20, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sd.find_anchors(df, shape)
    groups = sd.repeats(df, found, shape).join(found, ["gram", "context"]).selectExpr("repeat_id", "length", "doc_id", "at - left as s", f"at + {shape.gram} + right as e").collect()
    longest = max(r.length for r in groups)
    best = [r for r in groups if r.length == longest]
    assert longest == 26 and {r.doc_id for r in best} == set(range(5)) and all(rows[r.doc_id][1][r.s : r.e].startswith("the shared") for r in best)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
