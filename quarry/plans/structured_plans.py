"""Registered structured-data queries (S4, S5, Q1-Q7) and their DuckDB twins.

Questions are rendered from the orders rows ("Which orders have status F and
priority 1-URGENT?"); retrieval runs once per distinct question text and is
joined back to every order row.  Values come from the categorical columns
of orders and part.  ``o_orderstatus = 'F'`` plays the "delivered" status.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import structured
from quarry.plans.common import as_bigint, round6
from quarry.plans.sparse import bm25_sql
from quarry.sources.tables import TABLES, register_views, table

QUESTION = "Which orders have status %s and priority %s?"
VALUE_COLUMNS = {"orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_type"]}
CATALOG_TABLES = ["customer", "orders", "part", "lineitem"]
# Descriptions chosen by table name (T9) for the test tables.
DESCRIPTIONS = {
    "customer": "Contains customer demographic data.",
    "orders": "Contains transaction orders with customer and amounts.",
    "part": "Contains parts with brand, type and price.",
    "lineitem": "Contains order line items with quantities, prices and ship dates.",
}
DELIVERED = "F"
TOP_SPENDER_SQL = """
SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total_spent
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_custkey, c_name
ORDER BY total_spent DESC, c_name
LIMIT 1"""


def tables_row_counts(spark: SparkSession, sf: str):
    """Every table of the source opened and counted."""
    parts = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
             for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _values(spark, sf):
    out = None
    for t, cols in VALUE_COLUMNS.items():
        v = structured.value_index(table(spark, sf, t), t, cols)
        out = v if out is None else out.unionByName(v)
    return out


def value_index(spark: SparkSession, sf: str):
    return _values(spark, sf)


def _questions(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.format_string(QUESTION, "o_orderstatus", "o_orderpriority").alias("text"))


def _distinct_questions(spark, sf):
    # retrieval depends only on the text: score each distinct question once
    return _questions(spark, sf).select("text").distinct().withColumn("query_id", F.xxhash64("text"))


def value_topk(spark: SparkSession, sf: str):
    dq = _distinct_questions(spark, sf)
    hits = structured.value_topk(dq, _values(spark, sf), k=3)
    per_q = hits.select("query_id", "table_name", "node_id", "score", "rank").join(dq, "query_id").drop("query_id")
    out = _questions(spark, sf).join(per_q, "text").select("order_id", "table_name", "node_id", "score", "rank")
    return as_bigint(round6(out, "score"), "rank")


def _catalog(spark, sf):
    return structured.table_catalog(spark, {t: table(spark, sf, t) for t in CATALOG_TABLES}, DESCRIPTIONS)


def schema_topk(spark: SparkSession, sf: str):
    dq = _distinct_questions(spark, sf)
    hits = structured.schema_topk(dq, _catalog(spark, sf), k=2)
    out = _questions(spark, sf).join(hits.join(dq, "query_id").drop("query_id"), "text").select(
        "order_id", "table_name", "score", "rank"
    )
    return as_bigint(round6(out, "score"), "rank")


def sql_context(spark: SparkSession, sf: str):
    dq = _distinct_questions(spark, sf)
    cat = _catalog(spark, sf)
    ctx = structured.sql_context(structured.schema_topk(dq, cat, k=2), structured.value_topk(dq, _values(spark, sf), k=3), cat)
    return ctx.join(dq, "query_id").select("text", "context")


def top_spender(spark: SparkSession, sf: str):
    """Q5 + Q6: a stored SQL text run by Catalyst over registered views."""
    register_views(spark, sf, ["orders", "customer"])
    return structured.run_sql(spark, TOP_SPENDER_SQL)


def count_by_status_value(spark: SparkSession, sf: str):
    """Q7: how many orders have the 'delivered' status value."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == DELIVERED)
    return o.agg(F.count(F.lit(1)).alias("n_orders")).select(F.lit(DELIVERED).alias("status"), "n_orders")


# ---------------------------------------------------------------- oracle SQL

_VALUES_SQL = "\nUNION ALL\n".join(
    f"""SELECT DISTINCT '{t}' AS table_name, column_name, value, column_name || ': ' || value AS text,
       '{t}.' || column_name || '.' || value AS node_id
FROM (UNPIVOT (SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in cols)} FROM {t})
      ON {', '.join(cols)} INTO NAME column_name VALUE value)
WHERE value IS NOT NULL AND value <> ''"""
    for t, cols in VALUE_COLUMNS.items()
)
_Q = "SELECT o_orderkey AS order_id, printf('Which orders have status %s and priority %s?', o_orderstatus, o_orderpriority) AS text FROM orders"
_DQ = f"SELECT DISTINCT text, hash(text) AS query_id FROM ({_Q})"


def _catalog_sql() -> str:
    # column lists reflected from the tables' schemas in Spark; spelled out here
    cols = {
        "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
        "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
        "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
        "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    }
    rows = ", ".join(f"('{t}', '{t}: {cols[t]}. {DESCRIPTIONS[t]}')" for t in CATALOG_TABLES)
    return f"SELECT * FROM (VALUES {rows}) c(table_name, context_str)"


_VALUE_HITS = f"""
SELECT query_id, table_name, node_id, score, rank FROM (
  SELECT s.query_id, v.table_name, s.node_id, s.score,
         row_number() OVER (PARTITION BY s.query_id, v.table_name ORDER BY round(s.score, 9) DESC, s.node_id) AS rank
  FROM ({bm25_sql(None, queries_sql=_DQ, docs_sql=f"SELECT node_id, text FROM ({_VALUES_SQL})").replace(
      "SELECT query_id, node_id, round(score, 6) AS score FROM s WHERE score > 0",
      "SELECT query_id, node_id, score FROM s WHERE score > 0")}) s
  JOIN ({_VALUES_SQL}) v ON v.node_id = s.node_id) WHERE rank <= 3"""
_SCHEMA_HITS = bm25_sql(
    2, queries_sql=_DQ, docs_sql=f"SELECT table_name AS node_id, context_str AS text FROM ({_catalog_sql()})", rounded=False
)

ORACLE = {
    "tables_row_counts": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "value_index": _VALUES_SQL,
    "value_topk": f"""
SELECT q.order_id, h.table_name, h.node_id, round(h.score, 6) AS score, h.rank
FROM ({_Q}) q JOIN ({_DQ}) d ON d.text = q.text JOIN ({_VALUE_HITS}) h ON h.query_id = d.query_id""",
    "schema_topk": f"""
SELECT q.order_id, h.node_id AS table_name, round(h.score, 6) AS score, h.rank
FROM ({_Q}) q JOIN ({_DQ}) d ON d.text = q.text JOIN ({_SCHEMA_HITS}) h ON h.query_id = d.query_id""",
    "sql_context": f"""
WITH sh AS ({_SCHEMA_HITS}), vh AS ({_VALUE_HITS}), cat AS ({_catalog_sql()}),
  lines AS (SELECT sh.query_id, cat.context_str AS line FROM sh JOIN cat ON cat.table_name = sh.node_id
            UNION ALL
            SELECT vh.query_id, v.text AS line FROM vh JOIN sh ON sh.query_id = vh.query_id AND sh.node_id = vh.table_name
                 JOIN ({_VALUES_SQL}) v ON v.node_id = vh.node_id)
SELECT d.text, array_to_string(list_sort(list(line)), chr(10)) AS context
FROM lines JOIN ({_DQ}) d ON d.query_id = lines.query_id GROUP BY d.text""",
    "top_spender": TOP_SPENDER_SQL,
    "count_by_status_value": f"SELECT '{DELIVERED}' AS status, count(*) AS n_orders FROM orders WHERE o_orderstatus = '{DELIVERED}'",
}

QUERIES = {
    "tables_row_counts": tables_row_counts,
    "value_index": value_index,
    "value_topk": value_topk,
    "schema_topk": schema_topk,
    "sql_context": sql_context,
    "top_spender": top_spender,
    "count_by_status_value": count_by_status_value,
}
