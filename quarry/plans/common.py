"""Inputs shared by the registered queries: the driver tables seen as corpus,
query set, vectors and run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.embed import token_vectors
from quarry.sources.tables import table

VECTOR_DIMS = 64

# Token class used inside the oracle SQL (same as quarry.functions.text).
SQL_TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_tokens(x: str) -> str:
    return SQL_TOKENS.format(x=x)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents as retrievable nodes: node_id, text, source (plays file_name)."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text", "source")


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents for late text lookup by node_id."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text", "source")


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark passages as the query table: query_id, text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_vectors(df: DataFrame, id_col: str = "node_id") -> DataFrame:
    """(id, embedding) of any table of texts: every row has a vector."""
    return token_vectors(df, VECTOR_DIMS, id_col)


def text_vectors_sql(src: str, id_col: str) -> str:
    """DuckDB twin of ``text_vectors`` over ``src`` (id, text)."""
    return f"""
SELECT {id_col}, list(x ORDER BY slot) AS embedding FROM (
  SELECT g.{id_col}, g.slot, coalesce(sum(t.sign), 0)::DOUBLE AS x
  FROM (SELECT {id_col}, unnest(range({VECTOR_DIMS})) AS slot FROM ({src})) g
  LEFT JOIN (
    SELECT {id_col}, ('0x' || substr(md5(term), 1, 4))::INT % {VECTOR_DIMS} AS slot,
           CASE WHEN ('0x' || substr(md5(term), 5, 1))::INT < 8 THEN 1 ELSE -1 END AS sign
    FROM (SELECT {id_col}, unnest({sql_tokens('text')}) AS term FROM ({src}))) t
  ON t.{id_col} = g.{id_col} AND t.slot = g.slot
  GROUP BY g.{id_col}, g.slot) GROUP BY {id_col}"""


def dense_sql(queries: str, nodes: str, k: int, where: str = "true") -> str:
    """DuckDB cosine top-k of ``queries`` (query_id, embedding) over ``nodes`` (node_id, embedding);
    zero vectors are similar to nothing."""
    nonzero = "list_sum(list_transform({}.embedding, lambda x: abs(x))) > 0"
    return f"""
SELECT query_id, node_id, score, rank FROM (
  SELECT query_id, node_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank
  FROM (SELECT q.query_id, c.node_id, list_cosine_similarity(q.embedding, c.embedding) AS score
        FROM ({queries}) q, ({nodes}) c
        WHERE {nonzero.format('q')} AND {nonzero.format('c')} AND {where})) WHERE rank <= {k}"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as vector nodes: node_id, embedding, label."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def as_bigint(df: DataFrame, *cols: str) -> DataFrame:
    """Spark counts/ranks are INT where DuckDB gives BIGINT: align on BIGINT."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def round6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df
