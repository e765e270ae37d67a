from quarry.operators import structured

CUSTOMERS = [(1, "Ali", "Pakistan"), (2, "Sara", "Pakistan"), (3, "John", "USA")]
ORDERS = [(1, 1, "Laptop", 1500.0, "2026-07-01"), (2, 2, "Phone", 900.0, "2026-07-03"),
          (3, 1, "Monitor", 400.0, "2026-07-05"), (4, 3, "Laptop", 1700.0, "2026-07-08")]
STATUS_ORDERS = [(1, "Ali", "Laptop", "delivered", 1500.0), (2, "Sara", "Phone", "processing", 900.0),
                 (3, "John", "Monitor", "delivered", 400.0), (4, "Zainab", "Laptop", "shipped", 1700.0),
                 (5, "Bilal", "Phone", "cancelled", 900.0)]


def test_top_spender_fixture(spark):
    structured.create_table(spark, CUSTOMERS, "id long, name string, country string", "customers")
    structured.create_table(spark, ORDERS, "id long, customer_id long, product string, amount double, order_date string", "fx_orders")
    got = structured.run_sql(spark, """
        SELECT name, sum(amount) AS total FROM fx_orders JOIN customers ON customer_id = customers.id
        GROUP BY name ORDER BY total DESC, name LIMIT 1""").collect()
    assert [(r["name"], r["total"]) for r in got] == [("Ali", 1900.0)]


def test_status_count_and_value_index(spark):
    df = structured.create_table(spark, STATUS_ORDERS + [(6, "X", "", None, 1.0)],
                                 "id long, customer_name string, product string, status string, amount double", "status_orders")
    n = structured.run_sql(spark, "SELECT count(*) AS n FROM status_orders WHERE status = 'delivered'").first()["n"]
    assert n == 2
    vi = structured.value_index(df, "orders", ["status", "product"]).collect()
    assert len(vi) == 7
    assert {"status: delivered", "product: Monitor"} <= {r["text"] for r in vi}


def test_run_sql_rejects_writes(spark):
    import pytest
    with pytest.raises(ValueError):
        structured.run_sql(spark, "DROP TABLE x")


def test_catalog_and_schema_retrieval(spark):
    c = structured.create_table(spark, CUSTOMERS, "id long, name string, country string")
    o = structured.create_table(spark, ORDERS, "id long, customer_id long, product string, amount double, order_date string")
    cat = structured.table_catalog(spark, {"customers": c, "orders": o},
                                   {"customers": "Contains customer demographic data.",
                                    "orders": "Contains transaction orders with customer_id and amounts in USD."})
    cols = structured.catalog_columns(cat).collect()
    assert len(cols) == 8
    q = spark.createDataFrame([(1, "total amounts of orders")], "query_id long, text string")
    assert structured.schema_topk(q, cat, k=1).first()["table_name"] == "orders"


def test_udf_registration(spark):
    spark.udf.register("add_ints", lambda a, b: a + b, "long")
    assert spark.sql("SELECT add_ints(2, 3) AS s").first()["s"] == 5


def test_value_index_drops_falsy_values(spark):
    df = spark.createDataFrame([("a", 0), ("", 2), (None, 2), ("0", None)], "s string, n int")
    got = sorted((r["column_name"], r["value"]) for r in structured.value_index(df, "t", ["s", "n"]).collect())
    assert got == [("n", "2"), ("s", "0"), ("s", "a")]


def test_stored_sql_runs_queries_only(spark, tmp_path):
    import pytest

    from quarry.operators import structured

    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("guarded")
    assert structured.run_sql(spark, "WITH x AS (SELECT max(id) AS m FROM guarded) SELECT m FROM x;").first().m == 2
    path = str(tmp_path / "t")
    for bad in (f"WITH x AS (SELECT 9 AS id) INSERT INTO parquet.`{path}` SELECT id FROM x", "DROP VIEW guarded", "CREATE TABLE q (a INT)", "SELECT 1; DROP VIEW guarded", ""):
        with pytest.raises(ValueError):
            structured.run_sql(spark, bad)
    assert spark.read.parquet(path).count() == 3


def test_false_is_no_value(spark):
    from quarry.operators import structured

    df = spark.createDataFrame([(True, "x"), (False, ""), (None, None)], "flag boolean, name string")
    assert sorted(r.text for r in structured.value_index(df, "t", ["flag", "name"]).collect()) == ["flag: true", "name: x"]
