"""Registered ingestion queries (P1-P4, I1-I6, S7, S8, S12) and DuckDB twins.

Two-run scenario derived from the tables: the previous run ingested every
document; the incoming run re-sends English and Spanish documents unchanged,
French ones revised (a line appended), omits German ones, and adds every
benchmark passage as a new document (ids after the largest document id).
Documents of any other or no language are re-sent unchanged.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import stable_doc_id
from quarry.operators import bm25, chunking, ingest
from quarry.operators.ingest_buckets import BucketedIngest
from quarry.plans.common import as_bigint, bench_queries, round6
from quarry.plans.sparse import bm25_sql
from quarry.plans.tree_plans import fixed_chunks_sql
from quarry.session import work_path
from quarry.sources.collection import read_collection, write_collection
from quarry.sources.tables import table

TRANSFORM_ID = "split_256_20"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _incoming(spark, sf):
    german = F.col("lang").eqNullSafe(F.lit("de"))
    d = _docs(spark, sf).filter(~german).select(
        "doc_id",
        F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nrevised"))).otherwise(F.col("text")).alias("text"),
    )
    last = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] or 0
    new = table(spark, sf, "benchmark").select((F.col("item_id") + last + 1).alias("doc_id"), "text")
    return d.unionByName(new)


def _state(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("doc_hash"))


def _prev_chunks(spark, sf):
    return ingest.chunker_256(_docs(spark, sf).select("doc_id", "text"))


def stable_ids(spark: SparkSession, sf: str):
    return table(spark, sf, "documents").select("doc_id", stable_doc_id("source", "doc_id").alias("stable_id"))


def enrich_metadata(spark: SparkSession, sf: str):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_name"))
    return ingest.enrich(d)


def upsert_classify(spark: SparkSession, sf: str):
    return ingest.classify(_incoming(spark, sf), _state(spark, sf)).select("doc_id", "status")


def _upsert(spark, sf):
    return ingest.upsert(_prev_chunks(spark, sf), _state(spark, sf), _incoming(spark, sf), ingest.chunker_256)


def upsert_apply(spark: SparkSession, sf: str):
    return as_bigint(_upsert(spark, sf)[0], "chunk_no", "n_tokens")


def upsert_delta(spark: SparkSession, sf: str):
    return as_bigint(_upsert(spark, sf)[2], "chunk_no", "n_tokens")


def upsert_bucketed(spark: SparkSession, sf: str):
    """I2 against bucketed tables: both runs of the scenario, read at the second's version."""
    job = BucketedIngest(spark, work_path(spark, "bucketed"), buckets=16)
    job.run(_docs(spark, sf).select("doc_id", "text"), ingest.chunker_256)
    return as_bigint(job.chunks(job.run(_incoming(spark, sf), ingest.chunker_256)), "chunk_no", "n_tokens")


def cache_hits_misses(spark: SparkSession, sf: str):
    prev = _docs(spark, sf).select("doc_id", "text")
    cache = ingest.chunker_256(prev.withColumn("input_hash", F.sha2("text", 256))).select(
        "input_hash", F.lit(TRANSFORM_ID).alias("transform_id"), "chunk_no", "text"
    )
    hits, misses = ingest.cache_lookup(_incoming(spark, sf), cache, TRANSFORM_ID)
    return hits.select("doc_id", "input_hash", F.lit("hit").alias("cache_status")).unionByName(
        misses.select("doc_id", "input_hash", F.lit("miss").alias("cache_status"))
    )


def dedup_exact(spark: SparkSession, sf: str):
    return ingest.dedup_exact(table(spark, sf, "documents"))


def _chain(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", F.col("source").alias("file_name"))
    return ingest.transform_chain(d, [ingest.chunker_256, lambda x: ingest.enrich(x, "file_name")])


def ingest_transform_chain(spark: SparkSession, sf: str):
    return as_bigint(_chain(spark, sf), "chunk_no", "n_tokens")


def collection_roundtrip(spark: SparkSession, sf: str):
    """Write the enriched chunks as a collection partitioned by
    category, then re-open it with its declared schema."""
    path = work_path(spark, "collection")
    chunks = _chain(spark, sf)
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)
    back = spark.read.schema(chunks.schema).parquet(path)
    return as_bigint(back.select(*chunks.columns), "chunk_no", "n_tokens")


def collection_source(spark: SparkSession, sf: str):
    """S7/S8 through the collection source: written in one half after the other, then read back."""
    path = work_path(spark, "collection-source")
    chunks = _chain(spark, sf)
    for mode, even in (("overwrite", 0), ("append", 1)):
        write_collection(chunks.where(F.pmod("doc_id", F.lit(2)) == even), path, mode)
    return as_bigint(read_collection(spark, path), "chunk_no", "n_tokens")


def bm25_after_noop_ingest(spark: SparkSession, sf: str):
    """A no-op run yields an empty delta; the index is built from the full table."""
    docs = _docs(spark, sf).select("doc_id", "text")
    chunks, _, _ = ingest.upsert(_prev_chunks(spark, sf), _state(spark, sf), docs, ingest.chunker_256)
    hits = bm25.bm25_topk(bench_queries(spark, sf), chunks.select("node_id", "text"), k=5)
    return as_bigint(round6(hits, "score"), "rank")


# ---------------------------------------------------------------- oracle SQL

INCOMING_SQL = """
SELECT doc_id, CASE WHEN lang = 'fr' THEN text || chr(10) || 'revised' ELSE text END AS text
FROM documents WHERE lang IS DISTINCT FROM 'de'
UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents) AS doc_id, text FROM benchmark"""
_CLS = f"""
WITH inc AS ({INCOMING_SQL}),
  st AS (SELECT doc_id, sha256(text) AS doc_hash FROM documents),
  cls AS (SELECT inc.doc_id, inc.text,
                 CASE WHEN st.doc_hash IS NULL THEN 'new'
                      WHEN st.doc_hash <> sha256(inc.text) THEN 'changed' ELSE 'unchanged' END AS status
          FROM inc LEFT JOIN st ON st.doc_id = inc.doc_id),
  todo AS (SELECT doc_id, text FROM cls WHERE status <> 'unchanged')"""
_CHUNK_SQL = fixed_chunks_sql(*chunking.INGEST_CHUNK)
_DELTA_SQL = fixed_chunks_sql(*chunking.INGEST_CHUNK, src="SELECT doc_id, text FROM todo")
_CHAIN_SQL = f"""
SELECT c.*, d.source AS file_name, 'local_documents' AS source,
       CASE WHEN length(d.source) > 0
            THEN lower(regexp_replace(regexp_replace(d.source, '^\\s+', ''), '\\s+$', '')) END AS document_name,
       CASE WHEN contains(lower(coalesce(d.source, '')), 'rag') THEN 'rag'
            WHEN contains(lower(coalesce(d.source, '')), 'python') THEN 'python' ELSE 'general' END AS category
FROM ({_CHUNK_SQL}) c JOIN documents d ON d.doc_id = c.doc_id"""

_APPLY_SQL = _CLS + f"""
SELECT * FROM ({_CHUNK_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM todo)
UNION ALL SELECT * FROM ({_DELTA_SQL})"""

ORACLE = {
    "stable_ids": "SELECT doc_id, coalesce(source, doc_id::VARCHAR) AS stable_id FROM documents",
    "enrich_metadata": """
SELECT doc_id, source AS file_name, 'local_documents' AS source,
       CASE WHEN length(source) > 0
            THEN lower(regexp_replace(regexp_replace(source, '^\\s+', ''), '\\s+$', '')) END AS document_name,
       CASE WHEN contains(lower(coalesce(source, '')), 'rag') THEN 'rag'
            WHEN contains(lower(coalesce(source, '')), 'python') THEN 'python' ELSE 'general' END AS category
FROM documents""",
    "upsert_classify": _CLS + "\nSELECT doc_id, status FROM cls",
    "upsert_apply": _APPLY_SQL,
    "upsert_bucketed": _APPLY_SQL,
    "upsert_delta": _CLS + f"\nSELECT * FROM ({_DELTA_SQL})",
    "cache_hits_misses": f"""
WITH inc AS ({INCOMING_SQL}), c AS (SELECT DISTINCT sha256(text) AS h FROM documents)
SELECT doc_id, sha256(text) AS input_hash,
       CASE WHEN sha256(text) IN (SELECT h FROM c) THEN 'hit' ELSE 'miss' END AS cache_status FROM inc""",
    "dedup_exact": """
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1""",
    "ingest_transform_chain": _CHAIN_SQL,
    "collection_roundtrip": _CHAIN_SQL,
    "collection_source": _CHAIN_SQL,
    "bm25_after_noop_ingest": bm25_sql(5, docs_sql=f"SELECT node_id, text FROM ({_CHUNK_SQL})"),
}

QUERIES = {
    "stable_ids": stable_ids,
    "enrich_metadata": enrich_metadata,
    "upsert_classify": upsert_classify,
    "upsert_apply": upsert_apply,
    "upsert_bucketed": upsert_bucketed,
    "upsert_delta": upsert_delta,
    "cache_hits_misses": cache_hits_misses,
    "dedup_exact": dedup_exact,
    "ingest_transform_chain": ingest_transform_chain,
    "collection_roundtrip": collection_roundtrip,
    "collection_source": collection_source,
    "bm25_after_noop_ingest": bm25_after_noop_ingest,
}
