import pytest

from quarry.operators import chunking, hierarchy

NODES = [
    # node_id, parent_id, doc_id, level, seq
    ("r", None, 1, 0, 0),
    ("p1", "r", 1, 1, 0), ("p2", "r", 1, 1, 1),
    ("a", "p1", 1, 2, 0), ("b", "p1", 1, 2, 1),
    ("c", "p2", 1, 2, 2), ("d", "p2", 1, 2, 3),
]


def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, parent_id string, doc_id long, level int, seq int")


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, node_id string, score double, rank int")


def test_half_not_merged_full_merged(spark):
    got = {r["node_id"]: r["score"] for r in hierarchy.automerge(hits(spark, [(1, "a", 0.8, 1), (1, "c", 0.6, 2), (1, "d", 0.4, 3)]), nodes(spark)).collect()}
    # p1: 1 of 2 (ratio 0.5, not merged); p2: 2 of 2 -> parent with mean score;
    # then r: p2 only of 2 children -> not merged
    assert got == {"a": 0.8, "p2": pytest.approx(0.5)}


def test_two_levels_merge(spark):
    h = hits(spark, [(1, "a", 0.8, 1), (1, "b", 0.6, 2), (1, "c", 0.4, 3), (1, "d", 0.2, 4)])
    got = {r["node_id"]: r["score"] for r in hierarchy.automerge(h, nodes(spark)).collect()}
    assert got == {"r": pytest.approx(0.5)}


def test_fill_gap(spark):
    h = hits(spark, [(1, "a", 0.8, 1), (1, "c", 0.6, 2)])
    got = {r["node_id"]: r["score"] for r in hierarchy.fill_gaps(h, nodes(spark)).collect()}
    assert got == {"a": 0.8, "c": 0.6, "b": pytest.approx(0.7)}


def test_leaf_and_root(spark):
    n = nodes(spark)
    assert sorted(r["node_id"] for r in chunking.leaf_nodes(n).collect()) == ["a", "b", "c", "d"]
    assert [r["node_id"] for r in chunking.root_nodes(n).collect()] == ["r"]


def test_chunk_tree_shape(spark):
    text = " ".join(f"w{i}" for i in range(600))
    d = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    t = chunking.chunk_tree(d).collect()
    by_level = {}
    for r in t:
        by_level.setdefault(r["level"], []).append(r)
    assert [len(by_level[i]) for i in range(3)] == [2, 3, 5]
    assert {r["parent_id"] for r in by_level[2]} == {"1/0/0", "1/0/1", "1/1/2"}
    assert all(r["n_tokens"] <= 128 for r in by_level[2])


def test_chunk_fixed_counts(spark):
    d = spark.createDataFrame([(1, " ".join(["x"] * 700)), (2, ""), (3, "a b")], "doc_id long, text string")
    got = {}
    for r in chunking.chunk_fixed(d, 256, 20).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    # 700 tokens: 1 + ceil((700-256)/236) = 3 chunks; empty: none
    assert got == {1: 3, 3: 1}


def test_chunk_sentences_invariants(spark):
    text = "One two three. Four five six seven! Eight.\n" + " ".join(f"t{i}" for i in range(12)) + "."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(chunking.chunk_sentences(d, 5, 2).collect(), key=lambda r: r["chunk_no"])
    assert all(r["n_tokens"] <= 5 for r in rows)
    covered = set(" ".join(r["text"] for r in rows).split())
    assert covered == set(text.lower().replace(".", " ").replace("!", " ").split())


def test_automerge_with_fill(spark):
    # a and c retrieved, b filled in between -> p1 has 2 of 2 -> merged
    h = hits(spark, [(1, "a", 0.8, 1), (1, "c", 0.6, 2)])
    got = {r["node_id"]: r["score"] for r in hierarchy.automerge(h, nodes(spark), fill=True).collect()}
    assert set(got) == {"p1", "c"}
    assert got["p1"] == pytest.approx(0.75)


def _py_pack(text, size, overlap):
    """Plain-Python transcription of the packing rule (differential oracle)."""
    import math
    import re

    stride = size - overlap
    sents = [re.findall(r"\w+", s.lower()) for s in re.split(r"(?<=[.!?])\s+|\n+", text)]
    pieces = []
    for t in sents:
        if not t:
            continue
        n = 1 + max(0, math.ceil((len(t) - size) / stride))
        pieces += [t[i * stride:i * stride + size] for i in range(n)]
    done, cur, lens = [], [], []
    for p in pieces:
        if len(cur) + len(p) <= size:
            cur, lens = cur + p, lens + [len(p)]
            continue
        s = c = 0
        for x in reversed(lens):
            if s + x > overlap:
                break
            s, c = s + x, c + 1
        if cur:
            done.append(cur)
        if s > 0 and s + len(p) <= size:
            cur, lens = cur[len(cur) - s:] + p, lens[len(lens) - c:] + [len(p)]
        else:
            cur, lens = p, [len(p)]
    if cur:
        done.append(cur)
    return [" ".join(c) for c in done]


def test_chunk_sentences_matches_python_transcription(spark):
    from conftest import SF0001

    d = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    rows = d.collect()
    got = {}
    for r in chunking.chunk_sentences(d, 64, 12).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["text"]))
    for r in rows:
        exp = _py_pack(r["text"], 64, 12)
        assert [t for _, t in sorted(got.get(r["doc_id"], []))] == exp, r["doc_id"]


def test_chunk_sentences_on_random_texts(spark):
    import random

    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bb", "Ccc", "d1"])
    sentence = lambda: " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14]))) + rng.choice([". ", "! ", "\n", "?\n\n", ".", " "])
    texts = ["", " .\n", None] + ["".join(sentence() for _ in range(rng.randint(1, 25))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((1, 0), (4, 0), (6, 2), (7, 6), (10, 4)):
        got = {}
        for r in chunking.chunk_sentences(d, size, overlap).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["text"], r["n_tokens"]))
        for i, t in enumerate(texts):
            want = [(k, c, len(c.split())) for k, c in enumerate(_py_pack(t or "", size, overlap))]
            assert sorted(got.get(i, [])) == want, (size, overlap, t)


def test_chunk_sentences_of_a_very_long_text_take_linear_time(spark):
    import time

    def seconds(n):
        text = "The quick brown fox jumps over the lazy dog. " * n
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        assert chunking.chunk_sentences(d).agg({"n_tokens": "sum"}).first()[0] > 9 * n
        return time.time() - start

    seconds(20_000)  # warm-up
    short, long = seconds(55_000), seconds(220_000)  # 2.5 and 10 MB
    assert long < 8 * short + 3  # four times the text


def test_tree_without_texts_has_the_same_nodes(spark):
    from quarry.operators import chunking

    docs = spark.createDataFrame([(1, "w " * 700), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    whole = chunking.chunk_tree(docs)
    bare = chunking.chunk_tree(docs, texts=False)
    assert "text" not in bare.columns
    assert sorted(map(str, whole.drop("text").collect())) == sorted(map(str, bare.collect()))
