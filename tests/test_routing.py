import pytest

from quarry.operators import routing


def test_rule_routing(spark):
    q = spark.createDataFrame([(1, "What is ERR-401?"), (2, "what is meaning")], "query_id long, text string")
    got = {r["query_id"]: r["route"] for r in routing.route_by_rule(q).collect()}
    assert got == {1: "keyword", 2: "dense"}


def test_route_by_similarity(spark):
    q = spark.createDataFrame(
        [(1, "Which tool can multiply two numbers?"), (2, "zzz"), (3, "What are the main uses of Python?")],
        "query_id long, text string",
    )
    tools = {r["query_id"]: r["name"] for r in routing.route_by_similarity(q, routing.targets_df(spark, routing.FUNCTION_TARGETS)).collect()}
    assert tools[1] == "multiply" and tools[2] == "add"
    eng = {r["query_id"]: r["name"] for r in routing.route_by_similarity(q, routing.targets_df(spark, routing.ENGINE_TARGETS)).collect()}
    assert eng[3] == "python_query_engine"


def test_unknown_pointer_raises(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    hop1 = spark.createDataFrame([(1, 99)], "query_id long, index_id long")
    coll = spark.createDataFrame([(5, [1.0, 0.0], 1)], "node_id long, embedding array<double>, collection long")
    with pytest.raises(KeyError):
        routing.second_hop(q, hop1, coll)
