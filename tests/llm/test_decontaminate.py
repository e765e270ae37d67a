import random

import pytest
from conftest import SF0001

from quarry.llm import decontaminate as dc


def brute(text, passages):
    """Items with an aligned run of at least 2 equal tokens per substitution, over all diagonals."""
    words, out = dc.tokens(text), {}
    for item, p in passages:
        for d in range(-len(p), len(words)):
            eq = [0 <= d + j < len(words) and words[d + j] == p[j] for j in range(len(p))]
            best = run = matched = best_matched = 0
            for e in eq:
                run, matched = (run + 1, matched + 1) if e else (run - dc.PENALTY, matched)
                if run < 0:
                    run = matched = 0
                if run > best:
                    best, best_matched = run, matched
            if best_matched >= min(dc.MIN_TOKENS, len(p)) and 2 * best_matched >= len(p):
                out[item] = max(out.get(item, 0), best_matched)
    return out


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, leak string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, n): {x.item_id: x.matched for x in r.leaks} for n, r in enumerate(dc.with_leaks(d, b, **kw).collect())}


def test_query_against_brute_force(spark):
    items = [(r.item_id, dc.tokens(r.text)) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    want = {(r.doc_id, i): m for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect() if len(r.text) < 2500 for i, m in brute(r.text, items).items()}
    short = {r.doc_id for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect() if len(r.text) < 2500}
    got = {(r.doc_id, r.item_id): r.matched for r in dc.op1_decontaminate(spark, SF0001).collect() if r.doc_id in short}
    assert got == want and got


@pytest.mark.parametrize("block_tokens", [dc.BLOCK_TOKENS, 60])
def test_substitutions_are_tolerated(spark, block_tokens):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs = []
    for i, text in items:
        w = text.split()
        for j in rng.sample(range(30), 4):
            w[j] = "changed"
        docs.append((i, " ".join([word() for _ in range(40)] + w + [word() for _ in range(40)])))
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(10)]
    got = leaks(spark, docs, items, block_tokens=block_tokens)
    for (doc_id, _), found in got.items():
        assert set(found) == ({doc_id} if doc_id < 100 else set())


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    items = [(1, item), (2, item.upper() + "!"), (3, None), (4, ""), (5, "a b c"), (6, "alpha beta gamma delta epsilon"), (None, "k l m n o p q r s t u")]
    docs = [(1, None), (2, ""), (3, f"say: {item}."), (3, f"say: {item}."), (4, "a b c"), (5, "Alpha, beta gamma delta epsilon"), (None, "k l m n o p q r s t u"),
            (7, "one two three four"), (8, "five six seven eight nine ten"), (9, "w " * 200_000 + item), (10, "four five six seven eight"), (11, "a " * 3000)]
    got = leaks(spark, docs, items)
    want = {0: {}, 1: {}, 2: {1: 10}, 3: {1: 10}, 4: {5: 3}, 5: {6: 5}, 6: {None: 11}, 7: {}, 8: {}, 9: {1: 10}, 10: {}, 11: {}}
    assert {n: v for (_, n), v in got.items()} == want
    assert leaks(spark, docs[:3], []) == {(1, 0): {}, (2, 1): {}, (3, 2): {}}
    assert leaks(spark, [], items) == {}


def test_repeated_tokens_do_not_explode(spark):
    got = leaks(spark, [(1, "la " * 20_000)], [(1, "la " * 50), (2, "la " * 40)])
    assert list(got.values()) == [{1: 50, 2: 40}]


def test_long_items_are_found_by_their_passages(spark):
    rng = random.Random(4)
    w = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(1000)]
    got = leaks(spark, [(1, " ".join(w[300:520]))], [(9, " ".join(w))])
    assert list(got.values())[0].keys() == {9}


def test_verbatim_stretches_count_wherever_they_lie(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    own = {1: words(40), 2: words(256), 3: words(500), 4: words(1000), 5: words(60)}
    cuts = {1: (5, 24), 2: (60, 187), 3: (126, 374), 4: (250, 263), 5: (20, 32)}  # 12 tokens of item 5 are too few
    docs = [(i, " ".join(words(30) + own[i][a:b] + words(30))) for i, (a, b) in cuts.items()]
    docs += [(100 + a, " ".join(words(9) + own[4][a : a + 13])) for a in range(0, 988, 7)]
    got = leaks(spark, docs, [(i, " ".join(w)) for i, w in own.items()])
    for (doc, _), found in got.items():
        a, b = cuts.get(doc, (0, 13))
        assert found == ({} if doc == 5 else {4 if doc >= 100 else doc: b - a})


def test_stretches_of_one_item_give_one_row(spark):
    w = [f"w{i}" for i in range(3000)]
    items = [(1, " ".join(w[:10] + w[2000:2020])), (7, " ".join(w))]
    d = spark.createDataFrame([(1, " ".join(w[400:1500]))], "doc_id long, text string")
    got = dc.with_leaks(d, spark.createDataFrame(items, "item_id long, text string"), block_tokens=500).first().leaks
    assert [(x.item_id, x.start, x.length, x.matched, x.passage_tokens) for x in got] == [(7, 0, 1100, 1100, 3000)]
    assert dc.overlapping(70_000, 32_768)[-1][1] == 70_000
    entries = [(7, 0, 30, 30, 99), (7, 5, 40, 40, 99), (None, 1, 20, 20, 50), (7, 9, 40, 40, 99)]
    row = spark.createDataFrame([(entries,)], f"leaks {dc.LEAKS}").select(dc.best_of_each("leaks").alias("leaks")).first()
    assert [tuple(x) for x in row.leaks] == [entries[1], entries[2]]


def test_short_items_and_first_places(spark):
    items = [(1, "quux"), (2, "quux zap"), (3, "one two three four")]
    docs = [(1, "a quux b quux zap"), (2, "one two three four"), (3, "one two three"), (4, "la " * 3000 + "quux " * 2000)]
    rows = {r.doc_id: [(x.item_id, x.start, x.matched) for x in r.leaks] for r in dc.with_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert rows == {1: [(1, 1, 1), (2, 3, 2)], 2: [(3, 0, 4)], 3: [], 4: [(1, 3000, 1)]}


def test_equal_items_are_all_named(spark):
    b = spark.createDataFrame([(2, "x y"), (1, "X, y!"), (None, "x y"), (3, "z"), (3, "z"), (4, ""), (None, "n")], "item_id long, text string")
    got = sorted((tuple(r) for r in dc.equal_items(b).collect()), key=str)
    assert got == sorted([(1, 1), (1, 2), (1, None), (3, 3), (None, None)], key=str)
