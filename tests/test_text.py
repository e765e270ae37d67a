from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("r")).first()["r"]


def test_token_forms(spark):
    assert one(spark, T.tokenize, "Café ERR-401 naïve_x ИМЯ") == ["café", "err", "401", "naïve_x", "имя"]


def test_tokens_keep_duplicates_and_order(spark):
    assert one(spark, T.tokenize, "b a b") == ["b", "a", "b"]
    assert one(spark, T.tokenize, "") == []


def test_category(spark):
    got = [one(spark, T.category, v) for v in ["storage.txt", "My_Python.txt", "rag_python.txt", None]]
    assert got == ["rag", "python", "rag", "general"]


def test_document_name(spark):
    got = [one(spark, T.document_name, v) for v in ["  A.TXT ", "", None]]
    assert got == ["a.txt", None, None]


def test_parse_variants_lines(spark):
    assert one(spark, T.split_lines_clean, " q1 \n\n q2\t\r\n") == ["q1", "q2"]


def test_identifier_rule(spark):
    assert one(spark, T.identifier_like, "What is ERR-401?", ) is True
    assert one(spark, T.identifier_like, "what is meaning") is False


def test_stable_id(spark):
    df = spark.createDataFrame([("a.txt", "1"), (None, "2")], "f string, d string")
    assert [r[0] for r in df.select(T.stable_doc_id("f", "d")).collect()] == ["a.txt", "2"]
