"""Registered two-hop and routing queries (R1-R8) and their DuckDB twins.

Pointers are the label centroids of the vectors (one sub-collection per
label); text queries are the benchmark passages.  Passages and documents have
the vectors of their texts (as in the hybrid queries).  The knowledge-base engine
is the hybrid chain (fan-out, both retrievers, the dense one on the originals only,
fusion, rerank top 3), the second engine a plain dense search (k = 2).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, dense, routing
from quarry.plans.common import as_bigint, bench_queries, corpus, dense_sql, round6, text_vectors, text_vectors_sql, vectors
from quarry.plans.eval_plans import _cosine_sql
from quarry.plans.hybrid_plans import DOC_VECTORS_SQL, HYBRID_SQL, dense_nodes, hybrid_chain
from quarry.plans.sparse import bm25_sql

PLAIN_K = 2  # fixed value: the plain engine's k


def _pointers(spark, sf):
    return dense.centroids(vectors(spark, sf), "label").withColumnRenamed("label", "index_id")


def _vec_queries(spark, sf):
    return vectors(spark, sf).select(F.col("node_id").alias("query_id"), "embedding")


def pointer_first_hop(spark: SparkSession, sf: str):
    return round6(routing.first_hop(_vec_queries(spark, sf), _pointers(spark, sf)), "score")


def pointer_second_hop_topk(spark: SparkSession, sf: str):
    q = _vec_queries(spark, sf)
    hop1 = routing.first_hop(q, _pointers(spark, sf))
    coll = vectors(spark, sf).withColumnRenamed("label", "collection")
    hits = routing.second_hop(q, hop1, coll, k=2, exclude_self=True)
    return as_bigint(round6(hits, "score"), "rank")


def _text_dense(k):
    def run(spark, sf, qs):
        return dense.dense_topk(text_vectors(qs.select("query_id", "text"), "query_id"), dense_nodes(spark, sf), k)
    return run


def route_keyword_vs_dense(spark: SparkSession, sf: str):
    docs = corpus(spark, sf)
    routed = routing.route_by_rule(bench_queries(spark, sf))
    out = routing.run_routes(routed, {
        "keyword": lambda qs: bm25.bm25_topk(qs.select("query_id", "text"), docs, k=5),
        "dense": lambda qs: _text_dense(5)(spark, sf, qs),
    })
    return as_bigint(round6(out.select("query_id", "route", "node_id", "score", "rank"), "score"), "rank")


def route_by_description(spark: SparkSession, sf: str):
    q = bench_queries(spark, sf)
    decided = routing.route_by_similarity(q, routing.targets_df(spark, routing.ENGINE_TARGETS))
    routed = q.join(decided.select("query_id", F.col("name").alias("route")), "query_id")
    out = routing.run_routes(routed, {
        "enterprise_rag_engine": lambda qs: hybrid_chain(spark, sf, qs.select("query_id", "text"), every_variant=False).withColumnRenamed("rerank_score", "score"),
        "python_query_engine": lambda qs: _text_dense(PLAIN_K)(spark, sf, qs).select("query_id", "node_id", "score", "rank", F.lit(None).cast("double").alias("fused")),
    })
    return as_bigint(round6(out.select("query_id", "route", "node_id", "score", "rank"), "score"), "rank")


def tool_lookup(spark: SparkSession, sf: str):
    out = routing.route_by_similarity(bench_queries(spark, sf), routing.targets_df(spark, routing.FUNCTION_TARGETS))
    return round6(out.select("query_id", "name", "description", "sim"), "sim")


# ---------------------------------------------------------------- oracle SQL

_CENTROIDS = """
SELECT label::BIGINT AS index_id, list(x ORDER BY pos) AS embedding FROM (
  SELECT label, pos, avg(x::DOUBLE) AS x FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label"""
_HOP1 = f"""
SELECT query_id, index_id, score FROM (
  SELECT q.vec_id AS query_id, c.index_id,
         list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.vec_id
                            ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC,
                                     c.index_id) AS rn
  FROM embeddings q, ({_CENTROIDS}) c) WHERE rn = 1"""
_HOP2 = f"""
SELECT query_id, node_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, node_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank
  FROM (SELECT h.query_id, c.vec_id AS node_id,
               list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
        FROM ({_HOP1}) h JOIN embeddings q ON q.vec_id = h.query_id
             JOIN embeddings c ON c.label = h.index_id AND c.vec_id <> h.query_id)) WHERE rank <= 2"""


def _text_dense_sql(k: int, qfilter: str) -> str:
    queries = text_vectors_sql(f"SELECT b.item_id AS query_id, b.text FROM benchmark b WHERE {qfilter}", "query_id")
    return f"SELECT query_id, node_id, round(score, 6) AS score, rank FROM ({dense_sql(queries, DOC_VECTORS_SQL, k)})"


def _targets_sql(rows) -> str:
    vals = ", ".join(
        f"({tid}, '{name}', '{desc.replace(chr(39), chr(39) * 2)}')" for tid, name, desc in rows
    )
    return f"SELECT *, name || chr(10) || description AS target_text FROM (VALUES {vals}) t(target_id, name, description)"


def _route_sql(rows) -> str:
    pairs = (
        "SELECT b.item_id AS query_id, t.target_id, b.text AS question, t.target_text AS answer "
        f"FROM benchmark b, ({_targets_sql(rows)}) t"
    )
    sims = _cosine_sql(pairs, ["query_id", "target_id"], "question", "answer")
    return f"""
SELECT s.query_id, s.target_id, t.name, t.description, coalesce(s.relevancy_score, 0.0::DOUBLE) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY round(coalesce(relevancy_score, 0.0::DOUBLE), 9) DESC, target_id) AS rn
  FROM ({sims})) s JOIN ({_targets_sql(rows)}) t ON t.target_id = s.target_id WHERE rn = 1"""


_RULE = "regexp_matches(b.text, '[A-Za-z]+-[0-9]+|[0-9]+')"
_ENGINE = _route_sql(routing.ENGINE_TARGETS)

ORACLE = {
    "pointer_first_hop": f"SELECT query_id, index_id, round(score, 6) AS score FROM ({_HOP1})",
    "pointer_second_hop_topk": _HOP2,
    "route_keyword_vs_dense": f"""
SELECT query_id, 'keyword' AS route, node_id, score, rank
FROM ({bm25_sql(5, queries_sql=f"SELECT item_id AS query_id, text FROM benchmark b WHERE {_RULE}")})
UNION ALL
SELECT query_id, 'dense' AS route, node_id, score, rank FROM ({_text_dense_sql(5, 'NOT ' + _RULE)})""",
    "route_by_description": f"""
SELECT query_id, 'enterprise_rag_engine' AS route, node_id, rerank_score AS score, rank
FROM ({HYBRID_SQL}) WHERE query_id IN (SELECT query_id FROM ({_ENGINE}) WHERE name = 'enterprise_rag_engine')
UNION ALL
SELECT query_id, 'python_query_engine' AS route, node_id, score, rank
FROM ({_text_dense_sql(PLAIN_K, f"b.item_id IN (SELECT query_id FROM ({_ENGINE}) WHERE name = 'python_query_engine')")})""",
    "tool_lookup": f"SELECT query_id, name, description, round(sim, 6) AS sim FROM ({_route_sql(routing.FUNCTION_TARGETS)})",
}

QUERIES = {
    "pointer_first_hop": pointer_first_hop,
    "pointer_second_hop_topk": pointer_second_hop_topk,
    "route_keyword_vs_dense": route_keyword_vs_dense,
    "route_by_description": route_by_description,
    "tool_lookup": tool_lookup,
}
