import pytest

from quarry.operators import fusion


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, retriever string, node_id long, score double")


def test_rrf_fixture(spark):
    # list 1 = a(1), b(2); list 2 = b(2), c(3)
    h = hits(spark, [(1, "l1", 1, 0.9), (1, "l1", 2, 0.5), (1, "l2", 2, 3.0), (1, "l2", 3, 1.0)])
    got = {r["node_id"]: r["fused"] for r in fusion.rrf(h, ["query_id", "retriever"], top=None).collect()}
    assert got[2] == pytest.approx(1 / 61 + 1 / 60)
    assert got[1] == pytest.approx(1 / 60)
    assert got[3] == pytest.approx(1 / 61)


def test_rrf_does_not_depend_on_list_order(spark):
    rows = [(1, "l1", 1, 0.9), (1, "l1", 2, 0.5), (1, "l2", 2, 3.0), (1, "l2", 3, 1.0)]
    a = fusion.rrf(hits(spark, rows), ["query_id", "retriever"]).collect()
    b = fusion.rrf(hits(spark, list(reversed(rows))), ["query_id", "retriever"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_rrf_by_content_hash_merges_copies(spark):
    h = spark.createDataFrame(
        [(1, "l1", 5, 0.9, "h1"), (1, "l1", 7, 0.5, "h1"), (1, "l2", 8, 1.0, "h2")],
        "query_id long, retriever string, node_id long, score double, chash string",
    )
    got = {r["node_id"]: r["fused"] for r in fusion.rrf(h, ["query_id", "retriever"], identity="chash", top=None).collect()}
    assert got == {5: pytest.approx(1 / 60 + 1 / 61), 8: pytest.approx(1 / 60)}


def test_fanout_collapses_equal_variants(spark):
    q = spark.createDataFrame([(1, "orig")], "query_id long, text string")
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "orig"), (1, 3, "b"), (1, 4, "c")], "query_id long, variant int, text string")
    got = sorted((r["variant"], r["text"]) for r in fusion.fanout(q, v, 3).collect())
    assert got == [(0, "orig"), (1, "a"), (3, "b")]


def test_rerank_keeps_top_n(spark):
    c = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.2), (1, 3, 0.1)], "query_id long, node_id long, fused double")
    q = spark.createDataFrame([(1, "red apple pie")], "query_id long, text string")
    n = spark.createDataFrame([(1, "blue"), (2, "red apple"), (3, "apple pie red")], "node_id long, text string")
    got = [r["node_id"] for r in sorted(fusion.rerank(c, q, n, 2).collect(), key=lambda r: r["rank"])]
    assert got == [3, 2]
