"""Ingestion: enrichment, upserts against a registry, transformation cache,
de-duplication and the ordered transformation chain (P1-P4, I1-I6, S9-S12).

State lives in plain tables (``doc_state``, ``chunks``, ``chunk_cache``).
Every step is a join or an aggregation keyed by document id or content hash;
nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from quarry.functions.text import SOURCE_TAG, category, document_name, stable_doc_id
from quarry.operators import chunking
from quarry.operators.topk import store, top_k

DOC_STATE_SCHEMA = StructType(
    [
        StructField("doc_id", StringType(), False),
        StructField("doc_hash", StringType(), True),
        StructField("modified_at", TimestampType(), True),
    ]
)
CACHE_SCHEMA = StructType(
    [
        StructField("input_hash", StringType(), False),
        StructField("transform_id", StringType(), False),
        StructField("chunk_no", LongType(), True),
        StructField("text", StringType(), True),
    ]
)


def with_stable_ids(docs: DataFrame, file_name: str = "file_name", doc_id: str = "doc_id") -> DataFrame:
    """id = file name when present, else the given id."""
    return docs.withColumn(doc_id, stable_doc_id(file_name, doc_id))


def enrich(nodes: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Lineage tag, normalised document name, category from the file name."""
    return (
        nodes.withColumn("source", F.lit(SOURCE_TAG))
        .withColumn("document_name", document_name(file_name))
        .withColumn("category", category(file_name))
    )


def transform_chain(docs: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply transformations in list order (chunk -> embed -> enrich)."""
    out = docs
    for step in steps:
        out = out.transform(step)
    return out


def classify(incoming: DataFrame, state: DataFrame, text: str = "text") -> DataFrame:
    """New / changed / unchanged per incoming document (left join on id)."""
    return with_status(incoming.withColumn("doc_hash", F.sha2(F.col(text), 256)), state)


def with_status(hashed: DataFrame, state: DataFrame) -> DataFrame:
    """I1 for rows that carry ``doc_hash``.  Presence in the registry is a flag of
    its own, so a text that is or becomes null compares like any other."""
    st = state.select("doc_id", F.col("doc_hash").alias("_old"), F.lit(True).alias("_known"))
    return hashed.join(st, "doc_id", "left").withColumn(
        "status",
        F.when(F.col("_known").isNull(), F.lit("new"))
        .when(~F.col("_old").eqNullSafe(F.col("doc_hash")), F.lit("changed"))
        .otherwise(F.lit("unchanged")),
    ).drop("_old", "_known")


def upsert(
    chunks: DataFrame,
    state: DataFrame,
    incoming: DataFrame,
    chunker: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (new chunks table, new state, delta).

    Changed documents lose their old chunks, new and changed documents get
    fresh chunks; documents missing from the input are kept.  ``delta`` holds
    only the chunks of processed documents (empty for an unchanged input);
    indexes are built from the full table, never from the delta (S12).
    """
    # in-run de-duplication by id (I5): the newest row per document wins,
    # equal times resolved by content hash so the choice is deterministic
    order = [F.col("modified_at").desc_nulls_last()] if "modified_at" in incoming.columns else []
    hashed = incoming.withColumn("doc_hash", F.sha2(F.col("text"), 256))
    # versions are chosen and compared without their texts; only those of
    # new and changed documents are fetched.  These are stored without texts, so the joins
    # below know how few they are and send them to texts and chunks, which then stay in place.
    newest = top_k(hashed.drop("text"), ["doc_id"], [*order, F.col("doc_hash").desc_nulls_last()], 1, "_n").drop("_n")
    todo = with_status(newest, state).filter(F.col("status") != "unchanged")
    todo = store(todo.select(*[c for c in todo.columns if c in {"doc_id", "doc_hash", *state.columns}]), "upsert-todo")
    wanted = todo.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"))
    same = (F.col("doc_id") == F.col("_id")) & F.col("doc_hash").eqNullSafe(F.col("_hash"))
    texts = hashed.select("doc_id", "doc_hash", "text").join(wanted, same, "left_semi").dropDuplicates(["doc_id"])
    delta = chunker(texts.select("doc_id", "text"))
    kept = chunks.join(todo.select("doc_id"), "doc_id", "left_anti").select(*chunks.columns)
    new_chunks = kept.unionByName(delta)
    # new registry rows carry the incoming values of the state's columns
    # (null where the input has no such column, e.g. no modification time)
    fresh = todo.select(
        *[
            (F.col(f.name) if f.name in todo.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in state.schema.fields
        ]
    )
    new_state = state.join(todo.select("doc_id"), "doc_id", "left_anti").select(*state.columns).unionByName(fresh)
    return new_chunks, new_state, delta


def cache_lookup(incoming: DataFrame, cache: DataFrame, transform_id: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """I4: (hits, misses) of the transformation cache keyed (input hash, transform id).

    Hits come from an inner join with the cache, misses from a left anti
    join; only misses need the (expensive) transformation.
    """
    inc = incoming.withColumn("input_hash", F.sha2(F.col(text), 256))
    c = cache.filter(F.col("transform_id") == transform_id).select("input_hash").distinct()
    return inc.join(c, "input_hash", "left_semi"), inc.join(c, "input_hash", "left_anti")


def cached_transform(
    incoming: DataFrame, cache: DataFrame, transform_id: str, chunker: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """I4: chunks for all incoming documents, reusing cached results.

    Returns (chunks of every incoming document, cache entries to append).
    """
    hits, misses = cache_lookup(incoming, cache, transform_id)
    cached = hits.select("doc_id", "input_hash").join(
        cache.filter(F.col("transform_id") == transform_id), "input_hash"
    ).select("doc_id", "chunk_no", "text")
    fresh = chunker(misses.select("doc_id", "text", "input_hash"))
    new_entries = fresh.select("input_hash", F.lit(transform_id).alias("transform_id"), "chunk_no", "text")
    return cached.unionByName(fresh.select("doc_id", "chunk_no", "text")), new_entries


def dedup_by_id(docs: DataFrame, order_col: str = "modified_at") -> DataFrame:
    """I5 (by id): the newest row per document id."""
    return top_k(docs, ["doc_id"], [F.col(order_col).desc_nulls_last()], 1, "_n").drop("_n")


def dedup_exact(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """I5 (by content): one representative (smallest id) per distinct text.

    Aggregation by hash with partial aggregation: a text repeated across a
    third of the corpus is pre-reduced in every task before the shuffle.
    """
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.col(text), 256).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    )



def load_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a stored state table if present, else start empty."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def chunker_256(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    return chunking.chunk_fixed(docs, *chunking.INGEST_CHUNK, keep=keep)
