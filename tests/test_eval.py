import pytest

from quarry.operators import evaluate


def test_hit_rate_and_mrr(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "query_id long, node_id long, rank int")
    judged = spark.createDataFrame([(1, 12, True), (2, 20, False)], "query_id long, node_id long, relevant boolean")
    got = {r["query_id"]: (r["hit_rate"], r["mrr"]) for r in evaluate.hit_rate_mrr(q, hits, judged).collect()}
    assert got[1] == (1.0, pytest.approx(1 / 3))
    assert got[2] == (0.0, 0.0)
    assert got[3] == (0.0, 0.0)


def test_empty_evaluation_has_no_summary(spark):
    rows = spark.createDataFrame([], "query_id long, hit_rate double, mrr double, faithfulness_score double, "
                                     "relevancy_score double, latency_sec double")
    assert evaluate.summary(rows).count() == 0


def test_per_query_nulls_to_zero(spark):
    r = spark.createDataFrame([(1, None, 0.5)], "query_id long, hit_rate double, mrr double")
    row = evaluate.per_query(r).first()
    assert row["hit_rate"] == 0.0 and row["faithfulness_pass"] is False and row["latency_sec"] == 0.0


def test_groundedness_and_cosine(spark):
    p = spark.createDataFrame([(1, "a b c", "a b x")], "k long, q string, a string")
    g = p.select(evaluate.groundedness(p["a"], p["q"]).alias("g")).first()["g"]
    assert g == pytest.approx(2 / 3)
    c = evaluate.term_cosine(p, ["k"], "q", "a").first()["relevancy_score"]
    assert c == pytest.approx(2 / 3)
