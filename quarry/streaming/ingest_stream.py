"""Structured Streaming ingestion (ST1): the incremental form of I1-I4.

New and changed documents arrive as files of (doc_id, modified_at, text) in
an append-only drop folder.  Each micro-batch (``foreachBatch``):

1. keeps the newest version per document inside the batch; versions are ordered
   by (time, content hash), so that equal times have one winner,
2. drops versions not newer than the registered one (late, older data),
3. chunks the documents whose content changed, and writes the chunks, then the
   registry entries, into ``batch_id=N`` partitions of two append-only logs.  An
   unchanged text with a newer time only moves its registry entry on, which
   keeps pointing to the batch that holds its chunks.

Versions are compared without their texts; texts are joined last, for the
changed documents only.  Document ids may be of any type (``id_type``).

Writes are keyed by ``batch_id`` and overwrite their own partition, so a
replayed batch after a failure rewrites the same files (idempotent).  The
registry entry is written last: chunks of a half-written batch are invisible
because readers join chunks to registry entries.  The current state is the
newest registry entry per document (merge on read); the stream checkpoint
replaces the reference's JSON state files.

A changed document must arrive as a *new file*: the file source never
re-reads an overwritten path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType, TimestampType

from quarry.operators import ingest
from quarry.operators.topk import top_k

INPUT_SCHEMA = StructType(
    [
        StructField("doc_id", LongType(), False),
        StructField("modified_at", TimestampType(), False),
        StructField("text", StringType(), True),
    ]
)
REGISTRY_SCHEMA = StructType(
    [
        StructField("doc_id", LongType(), False),
        StructField("modified_at", TimestampType(), False),
        StructField("doc_hash", StringType(), True),
        StructField("chunk_batch", LongType(), True),
        StructField("batch_id", LongType(), False),
    ]
)
CHUNK_LOG_SCHEMA = StructType(
    [
        StructField("node_id", StringType(), False),
        StructField("doc_id", LongType(), False),
        StructField("chunk_no", LongType(), True),
        StructField("text", StringType(), True),
        StructField("n_tokens", LongType(), True),
        StructField("modified_at", TimestampType(), False),
        StructField("batch_id", LongType(), False),
    ]
)


def with_id_type(schema: StructType, id_type: DataType) -> StructType:
    """The schema with ``doc_id`` of another type (file names: ``StringType()``)."""
    return StructType([StructField(f.name, id_type, f.nullable) if f.name == "doc_id" else f for f in schema.fields])


class StreamIngest:
    """Registry + chunk logs under ``root`` (shared storage on a cluster).

    Every ``compact_every`` batches the registry is written as a snapshot, so
    that reading it stays bounded by the snapshot and the batches since.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        chunker: Callable[[DataFrame], DataFrame] = ingest.chunker_256,
        id_type: DataType = LongType(),
        compact_every: int = 20,
    ):
        self.input_schema, self.registry_schema, self.chunk_schema = (
            with_id_type(s, id_type) for s in (INPUT_SCHEMA, REGISTRY_SCHEMA, CHUNK_LOG_SCHEMA)
        )
        self.compact_every = compact_every
        self.spark = spark
        self.root = root.rstrip("/")
        self.registry_path = f"{self.root}/registry"
        self.chunks_path = f"{self.root}/chunks"
        self.checkpoint = f"{self.root}/_checkpoint"
        self.chunker = chunker

    # ---------------------------------------------------------------- read side
    def registry(self, before_batch: int | None = None) -> DataFrame:
        """Newest registry entry per document (optionally only from earlier batches).

        Reads the latest compacted snapshot (if any) plus the batch
        partitions written after it, so the read stays bounded by the
        snapshot size plus recent batches.
        """
        snap_batch, snap = self._latest_snapshot(before_batch)
        log = ingest.load_or_empty(self.spark, self.registry_path, self.registry_schema)
        if snap is not None:
            log = log.filter(F.col("batch_id") > snap_batch).unionByName(snap)
        if before_batch is not None:
            log = log.filter(F.col("batch_id") < before_batch)
        newest = [F.col("modified_at").desc(), F.col("doc_hash").desc_nulls_last(), F.col("batch_id").desc()]
        return top_k(log, ["doc_id"], newest, 1, "_n").drop("_n")

    def _snapshots(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/registry_snapshot")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("upto=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[5:]))
        return sorted(out)

    def _latest_snapshot(self, before_batch: int | None):
        snaps = [b for b in self._snapshots() if before_batch is None or b < before_batch]
        if not snaps:
            return None, None
        b = snaps[-1]
        return b, self.spark.read.schema(self.registry_schema).parquet(f"{self.root}/registry_snapshot/upto={b}")

    def compact(self) -> int | None:
        """Write the current registry (newest entry per document) as a snapshot
        covering every batch so far; later reads start from it.  The
        snapshot is complete only once its ``_SUCCESS`` marker exists."""
        log = ingest.load_or_empty(self.spark, self.registry_path, self.registry_schema)
        upto = log.agg(F.max("batch_id")).first()[0]
        if upto is None:
            return None
        self.registry().write.mode("overwrite").parquet(f"{self.root}/registry_snapshot/upto={upto}")
        return int(upto)

    def current_chunks(self) -> DataFrame:
        """Chunks of the current version of every document."""
        chunks = ingest.load_or_empty(self.spark, self.chunks_path, self.chunk_schema)
        cur = self.registry().select("doc_id", F.col("chunk_batch").alias("batch_id"))
        return chunks.join(cur, ["doc_id", "batch_id"], "left_semi").select(
            "node_id", "doc_id", "chunk_no", "text", "n_tokens"
        )

    # --------------------------------------------------------------- write side
    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("doc_hash", F.sha2("text", 256))
        order = [F.col("modified_at").desc(), F.col("doc_hash").desc_nulls_last()]
        newest = top_k(hashed.select("doc_id", "modified_at", "doc_hash"), ["doc_id"], order, 1, "_n").drop("_n")
        reg = self.registry(before_batch=batch_id).select(
            "doc_id", F.col("modified_at").alias("_time"), F.col("doc_hash").alias("_hash"), F.col("chunk_batch").alias("_chunks")
        )
        known, same = F.col("_time").isNotNull(), F.col("doc_hash").eqNullSafe(F.col("_hash"))
        hash_after = F.coalesce(F.col("doc_hash"), F.lit("")) > F.coalesce(F.col("_hash"), F.lit(""))
        newer = (F.col("modified_at") > F.col("_time")) | ((F.col("modified_at") == F.col("_time")) & hash_after)
        entry_path = f"{self.registry_path}/batch_id={batch_id}"
        accepted = newest.join(reg, "doc_id", "left").filter(~known | newer).select(
            "doc_id", "modified_at", "doc_hash", F.when(known & same, F.col("_chunks")).otherwise(F.lit(batch_id)).cast("long").alias("chunk_batch")
        ).persist()
        changed = accepted.filter(F.col("chunk_batch") == batch_id)
        wanted = changed.select(F.col("doc_id").alias("_id"), F.col("modified_at").alias("_at"), F.col("doc_hash").alias("_hash"))
        on = (F.col("doc_id") == F.col("_id")) & (F.col("modified_at") == F.col("_at")) & F.col("doc_hash").eqNullSafe(F.col("_hash"))
        texts = hashed.join(wanted, on, "left_semi").dropDuplicates(["doc_id"]).withColumn("batch_id", F.lit(batch_id).cast("long"))
        chunks = self.chunker(texts.select("doc_id", "text", "modified_at", "batch_id"))
        chunks.select(*[f.name for f in self.chunk_schema.fields if f.name != "batch_id"]).write.mode("overwrite").parquet(
            f"{self.chunks_path}/batch_id={batch_id}"
        )
        accepted.write.mode("overwrite").parquet(entry_path)
        accepted.unpersist()
        if batch_id % self.compact_every == self.compact_every - 1:
            self.compact()

    def run(self, drop_dir: str, files_per_batch: int | None = None, available_now: bool = True):
        """Process the drop folder; with ``available_now`` it stops when caught up.

        A batch takes all files that are there, unless ``files_per_batch`` limits it.
        """
        stream = self.spark.readStream.schema(self.input_schema)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        stream = stream.parquet(drop_dir)
        w = stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", self.checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        q = w.start()
        if available_now:
            q.awaitTermination()
        return q
