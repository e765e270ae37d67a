"""Registered streaming ingestion query (ST1) and its DuckDB twin.

Drop-folder files derived from documents, in arrival order: originals in all
languages but French and German (or none); French originals; German originals;
the first again with a later time but unchanged; French revisions (a
line appended, one day later); stale German versions (one day *earlier*,
arriving last: must be ignored).  The final state must equal the batch
upsert of the newest versions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.plans.common import as_bigint
from quarry.plans.tree_plans import fixed_chunks_sql
from quarry.session import work_path
from quarry.sources.tables import table
from quarry.streaming.ingest_state import StateIngest
from quarry.streaming.ingest_stream import StreamIngest

T0 = "2026-01-01 00:00:00"
T_REVISED = "2026-01-02 00:00:00"
T_STALE = "2025-12-31 00:00:00"


def _arrivals(spark, sf):
    d = table(spark, sf, "documents")
    ts = lambda s: F.to_timestamp(F.lit(s))
    others = ~F.coalesce(F.col("lang").isin("fr", "de"), F.lit(False))
    arrivals = [
        d.filter(others).select("doc_id", ts(T0).alias("modified_at"), "text"),
        d.filter(F.col("lang") == "fr").select("doc_id", ts(T0).alias("modified_at"), "text"),
        d.filter(F.col("lang") == "de").select("doc_id", ts(T0).alias("modified_at"), "text"),
        d.filter(others).select("doc_id", ts(T_REVISED).alias("modified_at"), "text"),
        d.filter(F.col("lang") == "fr").select(
            "doc_id", ts(T_REVISED).alias("modified_at"), F.concat("text", F.lit("\nrevised")).alias("text")
        ),
        d.filter(F.col("lang") == "de").select(
            "doc_id", ts(T_STALE).alias("modified_at"), F.concat("text", F.lit("\nstale")).alias("text")
        ),
    ]
    return arrivals


def stream_ingest(spark: SparkSession, sf: str):
    root = work_path(spark, "stream-ingest")
    drop = f"{root}/drop"
    job = StreamIngest(spark, root, compact_every=4)
    for arrival in _arrivals(spark, sf):
        arrival.write.mode("append").parquet(drop)
        job.run(drop)
    return as_bigint(job.current_chunks(), "chunk_no", "n_tokens")


def stream_ingest_state(spark: SparkSession, sf: str):
    """The same arrivals into keyed state; each arrival is a run of its own, restarted from the checkpoint."""
    root = work_path(spark, "stream-state")
    drop = f"{root}/drop"
    for arrival in _arrivals(spark, sf):
        arrival.write.mode("append").parquet(drop)
        job = StateIngest(spark, root)
        job.run(drop)
    return as_bigint(job.current_chunks(), "chunk_no", "n_tokens")


_NEWEST = fixed_chunks_sql(
    *chunking.INGEST_CHUNK,
    src="SELECT doc_id, CASE WHEN lang = 'fr' THEN text || chr(10) || 'revised' ELSE text END AS text FROM documents",
)
ORACLE = {"stream_ingest": _NEWEST, "stream_ingest_state": _NEWEST}

QUERIES = {"stream_ingest": stream_ingest, "stream_ingest_state": stream_ingest_state}
