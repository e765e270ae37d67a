"""Registered queries over stored, versioned state (B6, B8, S9-S12, I1-I4) and their DuckDB twins.

The ingestion scenario is that of ``ingest_plans``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, ingest, text_index
from quarry.operators.ingest_store import IngestStore
from quarry.plans.common import as_bigint, bench_queries, corpus, round6
from quarry.plans.ingest_plans import INCOMING_SQL, ORACLE as INGEST_SQL, TRANSFORM_ID, _docs, _incoming
from quarry.plans.sparse import BM25_TOPK_SQL, bm25_sql
from quarry.plans.tree_plans import fixed_chunks_sql
from quarry.session import work_path


def _hits(queries, index):
    return as_bigint(round6(text_index.topk(queries, index, 5), "score"), "rank")


def bm25_index_topk(spark: SparkSession, sf: str):
    """The index is built, re-opened from its folder and queried; rows of ``bm25_topk``."""
    root = work_path(spark, "text-index")
    text_index.build(corpus(spark, sf), root)
    return _hits(bench_queries(spark, sf), text_index.open_index(spark, root))


def _upserted(spark, sf):
    """All documents indexed, then French ones revised and passages added, then German ones deleted."""
    root = work_path(spark, "text-index")
    docs = _docs(spark, sf).select(F.col("doc_id").alias("node_id"), "text", "lang")
    text_index.build(docs, root)
    incoming = _incoming(spark, sf).withColumnRenamed("doc_id", "node_id")
    known = docs.select("node_id", F.xxhash64("text").alias("old"))
    changed = incoming.join(known, "node_id", "left").where(~F.xxhash64("text").eqNullSafe(F.col("old"))).select("node_id", "text")
    text_index.upsert(root, changed)
    german = docs.where("lang = 'de'").select("node_id")
    text_index.upsert(root, changed.limit(0), german)
    return root


def bm25_index_after_upserts(spark: SparkSession, sf: str):
    """Three segments with deletion marks give the rows of a full rebuild."""
    return _hits(bench_queries(spark, sf), text_index.open_index(spark, _upserted(spark, sf)))


def bm25_index_merged(spark: SparkSession, sf: str):
    """The same after the segments are merged into one."""
    return _hits(bench_queries(spark, sf), text_index.merge(spark, _upserted(spark, sf)))


def _two_runs(spark, sf):
    st = IngestStore(spark, work_path(spark, "ingest-store"))
    st.run(_docs(spark, sf).select("doc_id", "text"), ingest.chunker_256, TRANSFORM_ID)
    return st, st.run(_incoming(spark, sf), ingest.chunker_256, TRANSFORM_ID)


def ingest_versions(spark: SparkSession, sf: str):
    """Chunks of the second published version; rows of ``upsert_apply``."""
    st, snapshot = _two_runs(spark, sf)
    return as_bigint(st.chunks(snapshot).select("node_id", "doc_id", "chunk_no", "text", "n_tokens"), "chunk_no", "n_tokens")


def ingest_cache(spark: SparkSession, sf: str):
    """The cache as the second run published it: every text that came, transformed once."""
    _, snapshot = _two_runs(spark, sf)
    return as_bigint(snapshot.read(spark, "cache").where(F.col("chunk_no").isNotNull()).select("input_hash", "chunk_no", "text"), "chunk_no")


_FINAL = f"SELECT doc_id AS node_id, text FROM ({INCOMING_SQL})"
_TEXTS = f"SELECT DISTINCT sha256(text) AS doc_id, text FROM (SELECT text FROM documents UNION ALL SELECT text FROM ({INCOMING_SQL}))"

ORACLE = {
    "bm25_index_topk": BM25_TOPK_SQL,
    "bm25_index_after_upserts": bm25_sql(5, docs_sql=_FINAL),
    "bm25_index_merged": bm25_sql(5, docs_sql=_FINAL),
    "ingest_versions": INGEST_SQL["upsert_apply"],
    "ingest_cache": f"SELECT doc_id AS input_hash, chunk_no, text FROM ({fixed_chunks_sql(*chunking.INGEST_CHUNK, src=_TEXTS)})",
}

QUERIES = {
    "bm25_index_topk": bm25_index_topk,
    "bm25_index_after_upserts": bm25_index_after_upserts,
    "bm25_index_merged": bm25_index_merged,
    "ingest_versions": ingest_versions,
    "ingest_cache": ingest_cache,
}
