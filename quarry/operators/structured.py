"""Structured data: catalog, value index, schema/value retrieval, SQL context."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from quarry.operators import bm25
from quarry.operators.topk import rank_by_score


def create_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str, name: str | None = None) -> DataFrame:
    """A table with declared types (optionally registered as a view)."""
    df = spark.createDataFrame(list(rows), schema)
    if name:
        df.createOrReplaceTempView(name)
    return df


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """One row per table: columns (name, type) and a context text.

    Built from the schemas (metadata only, no data read).
    """
    rows = []
    for name, df in tables.items():
        cols = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        desc = (descriptions or {}).get(name, "")
        ctx = f"{name}: " + ", ".join(c for c, _ in cols) + (f". {desc}" if desc else "")
        rows.append((name, cols, ctx))
    return spark.createDataFrame(
        rows, "table_name string, columns array<struct<name:string,type:string>>, context_str string"
    )


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """(table_name, position, column_name, data_type)."""
    return catalog.select("table_name", F.posexplode("columns").alias("position", "c")).select(
        "table_name", "position", F.col("c.name").alias("column_name"), F.col("c.type").alias("data_type")
    )


def value_index(df: DataFrame, table_name: str, columns: Sequence[str]) -> DataFrame:
    """Q2: distinct non-empty values of categorical columns in ONE scan:
    unpivot -> filter (P8) -> distinct (partial + final aggregation).

    Output: (table_name, column_name, value, text = "col: val", node_id).
    """
    def as_value(c: str):
        # truthiness (P8): numeric zero and false are dropped like null and ""
        if isinstance(df.schema[c].dataType, NumericType):
            return F.when(F.col(c) != 0, F.col(c).cast("string")).alias(c)
        if isinstance(df.schema[c].dataType, BooleanType):
            return F.when(F.col(c), F.lit("true")).alias(c)
        return F.col(c).cast("string").alias(c)

    long = df.select(*[as_value(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    vals = long.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    return vals.select(
        F.lit(table_name).alias("table_name"),
        "column_name",
        "value",
        F.concat_ws(": ", "column_name", "value").alias("text"),
        F.concat_ws(".", F.lit(table_name), "column_name", "value").alias("node_id"),
    )


def value_topk(questions: DataFrame, values: DataFrame, k: int = 3) -> DataFrame:
    """Q3: best ``k`` values per question and table (BM25 over the value texts)."""
    scores = bm25.bm25_scores(questions, values.select("node_id", "text")).filter(F.col("score") > 0)
    with_table = scores.join(values.select("node_id", "table_name", "text"), "node_id")
    return rank_by_score(with_table, ["query_id", "table_name"], k)


def schema_topk(questions: DataFrame, catalog: DataFrame, k: int = 2) -> DataFrame:
    """Q1: best ``k`` tables per question (BM25 over the catalog context texts)."""
    docs = catalog.select(F.col("table_name").alias("node_id"), F.col("context_str").alias("text"))
    return bm25.bm25_topk(questions, docs, k=k).withColumnRenamed("node_id", "table_name")


def sql_context(tables: DataFrame, values: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q4: per question the chosen tables' schema text plus matched values,
    as one sorted, newline-joined context string (bounded: k tables + k values)."""
    cat = catalog.select("table_name", "context_str")
    t = tables.join(cat, "table_name").select(
        "query_id", F.col("context_str").alias("line")
    )
    v = values.join(tables.select("query_id", "table_name"), ["query_id", "table_name"]).select(
        "query_id", F.col("text").alias("line")
    )
    return t.unionByName(v).groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("context")
    )


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Q5: run a stored SQL text over the registered views (SELECT only).

    The text becomes the body of a temporary view, where Spark's grammar takes
    a query and nothing else: writes and commands, also behind a WITH, do not
    parse there.
    """
    name = f"stored_sql_{uuid.uuid4().hex}"
    try:
        spark.sql(f"CREATE TEMPORARY VIEW {name} AS {text.strip().rstrip(';')}")
    except ParseException as e:
        raise ValueError(f"only SELECT statements are run: {e}") from None
    try:
        return spark.table(name)
    finally:
        spark.catalog.dropTempView(name)
