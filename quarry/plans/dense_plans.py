"""Registered dense-retrieval queries (V2, V3, P5, P6, P9) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import snippet
from quarry.operators import bm25, dense
from quarry.operators.retrievers import metadata_filter
from quarry.plans.sparse import BM25_TOPK_SQL
from quarry.plans.common import as_bigint, bench_queries, corpus, doc_texts, round6, vectors
from quarry.sources.tables import table

SIM_CUTOFF = 0.30  # fixed value of the reference post-processor


def cosine_pairs(spark: SparkSession, sf: str):
    """V2 on an equi-join: every vector against its successor id."""
    v = vectors(spark, sf)
    nxt = v.select(F.col("node_id").alias("next_id"), F.col("embedding").alias("e2"))
    out = v.join(nxt, F.col("next_id") == F.col("node_id") + 1).select(
        "node_id", "next_id", dense.cosine("embedding", "e2").alias("cosine")
    )
    return round6(out, "cosine")


def _vec_queries(spark, sf):
    return vectors(spark, sf).select(F.col("node_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, sf: str, k: int = 5):
    """V3: every vector queries all others (self excluded), top 5 by cosine."""
    hits = dense.dense_topk(_vec_queries(spark, sf), vectors(spark, sf), k, exclude_self=True)
    return as_bigint(round6(hits, "score"), "rank")


def labelled_vectors(spark, sf):
    """Vector nodes with the metadata of the same-id document's labels."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("node_id"), "quality", "toxic")
    return vectors(spark, sf).join(lab, "node_id")


def dense_topk_filtered(spark: SparkSession, sf: str, k: int = 5):
    """P5: metadata equality filters (AND) applied before scoring."""
    nodes = metadata_filter(labelled_vectors(spark, sf), {"quality": 1, "toxic": 0})
    hits = dense.dense_topk(_vec_queries(spark, sf), nodes, k, exclude_self=True)
    return as_bigint(round6(hits, "score"), "rank")


def similarity_cutoff(spark: SparkSession, sf: str):
    """Keep hits scoring at least the cutoff (null scores drop)."""
    hits = dense.dense_topk(_vec_queries(spark, sf), vectors(spark, sf), 5, exclude_self=True)
    return as_bigint(round6(hits.filter(F.col("score") >= SIM_CUTOFF), "score"), "rank")


def snippets(spark: SparkSession, sf: str):
    """Display snippets (200/300/500 characters) of the BM25 hits."""
    hits = bm25.bm25_topk(bench_queries(spark, sf), corpus(spark, sf), k=5)
    out = bm25.attach_nodes(hits, doc_texts(spark, sf), cols=("text",)).select(
        "query_id", "node_id", "rank",
        snippet("text", 200).alias("snip200"),
        snippet("text", 300).alias("snip300"),
        snippet("text", 500).alias("snip500"),
    )
    return as_bigint(out, "rank")


_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _topk_sql(where: str, k: int = 5, nodes: str = "embeddings", extra: str = "") -> str:
    cos = _COS.format(a="q.embedding", b="c.embedding")
    return f"""
WITH c AS (SELECT * FROM {nodes}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS node_id, {cos} AS score
      FROM embeddings q JOIN c ON {where})
SELECT query_id, node_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, node_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank
  FROM s WHERE score IS NOT NULL) WHERE rank <= {k}{extra}"""


_FILTERED_NODES = (
    "(SELECT e.* FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality = 1 AND l.toxic = 0)"
)

ORACLE = {
    "cosine_pairs": f"""
SELECT a.vec_id AS node_id, b.vec_id AS next_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "dense_topk": _topk_sql("q.vec_id <> c.vec_id"),
    "dense_topk_filtered": _topk_sql("q.vec_id <> c.vec_id", nodes=_FILTERED_NODES),
    "similarity_cutoff": f"SELECT * FROM ({_topk_sql('q.vec_id <> c.vec_id')}) WHERE score >= 0.30::DOUBLE",
    "snippets": """
WITH h AS ({bm25})
SELECT h.query_id, h.node_id, h.rank, substr(d.text, 1, 200) AS snip200, substr(d.text, 1, 300) AS snip300,
       substr(d.text, 1, 500) AS snip500
FROM h JOIN documents d ON d.doc_id = h.node_id""".replace("{bm25}", BM25_TOPK_SQL),
}

QUERIES = {
    "cosine_pairs": cosine_pairs,
    "dense_topk": dense_topk,
    "dense_topk_filtered": dense_topk_filtered,
    "similarity_cutoff": similarity_cutoff,
    "snippets": snippets,
}
