import math
import zlib
from collections import Counter
from functools import cache

import pytest
from conftest import SF0001

from quarry.llm import lm_score


def brute_base(rows):
    """{doc_id: (held_out, n_tokens, n_known, N, base)} by plain Python."""
    words = lambda t: (t or "").encode().lower().split() + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    score = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
    return {i: (out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, score(t)) for i, t in rows}


def brute_marginal(word, scores):
    """Sum over all segmentations, by recursion on the first piece."""
    word = "▁" + word

    @cache
    def rest(i):
        if i == len(word):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(word) + 1):
            p = scores.get(word[i:j])
            if p is not None:
                total += math.exp(p) * rest(j)
        if word[i] not in scores:
            total += math.exp(sum(scores[f"<0x{b:02X}>"] for b in word[i].encode())) * rest(i + 1)
        return total

    return math.log(rest(0))


@pytest.mark.parametrize("head", [0, 50, 100_000])
def test_query_against_brute_force(spark, head):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    want = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    got = lm_score.score(docs, head=head).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0


def test_lattice_sums_all_segmentations():
    scores = {p: math.log((i + 1) / 100) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba", "<0xC3>", "<0xA9>"])}
    score = lm_score.lattice(scores)
    for w in ["", "a", "ab", "abab", "aabbaba", "aéb", "é"]:
        assert score(w) == pytest.approx(brute_marginal(w, scores), rel=1e-12)


def test_marginal_is_at_least_the_best_segmentation_and_long_words_work():
    scores = {"▁": -1.0, "a": -2.0, "aa": -3.0}
    score = lm_score.lattice(scores)
    assert score("aa") > max(-1 - 4, -1 - 3)
    assert math.isfinite(score("a" * 200_000))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "The cat"), (3, "The cat"), (4, "x" * 50_000), (5, " \t\n  "), (None, "the dog ÉA")]
    out = lm_score.score(spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")).collect()
    assert len(out) == len(rows)
    want = brute_base(rows)
    for r in out:
        assert (r.held_out, r.n_tokens) == want[r.doc_id][:2]
    twice = [r for r in out if r.doc_id == 3]
    assert twice[0] == twice[1]
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_prose_scores_better_than_noise(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").limit(100)
    rows = docs.collect()
    noise = spark.createDataFrame([(1_000_001 + i, "zqx wvk qqj xzw " * 50) for i in range(5)], "doc_id long, text string")
    per_token = {r.doc_id: r.score / r.n_tokens for r in lm_score.score(docs.unionByName(noise)).where("held_out").collect()}
    junk = [s for i, s in per_token.items() if i > 1_000_000]
    prose = [s for i, s in per_token.items() if i <= 1_000_000]
    assert len(rows) == 100 and prose and (not junk or max(junk) < sorted(prose)[len(prose) // 2])
