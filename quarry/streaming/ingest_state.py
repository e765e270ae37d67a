"""Streaming ingestion with keyed state (ST1): one registry entry per document.

The same versions win as in ``ingest_stream.StreamIngest`` - newest (time, content
hash) per document, a late older one is ignored, an unchanged text is not chunked
again - but the registry is the stream's own state instead of a log that each batch
reads: ``transformWithState`` keeps one entry per document id in the task that owns
its partition, and hands on the text of a new or changed version only.  A batch's
cost grows with its own rows, not with the documents seen before.

* The chunks of a batch are written once, into ``chunks/batch_id=N``, stamped with the
  version they belong to.  A replayed batch starts from the state before it and
  overwrites its own folder.
* Readers take the entries of the last committed batch (Spark's ``statestore`` source)
  and the chunks of exactly those versions, so a half-written batch is invisible.
* With ``expire_after_ms`` an entry goes when neither its version nor a newer one has
  arrived for that time: its chunks are no longer read, and the document counts as new
  when it comes again.  Without it entries stay for good.

The state's partitions are ``spark.sql.shuffle.partitions`` at the first run, kept by
the checkpoint.  Of a document's versions in a batch one at a time is in memory, and
the newest so far.  Rows without an id are left out; a null time is before all
others; a null text is a version without chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from quarry.operators import ingest
from quarry.streaming.ingest_stream import INPUT_SCHEMA, with_id_type

ENTRY_SCHEMA = StructType(
    [
        StructField("modified_us", LongType(), False),
        StructField("doc_hash", StringType(), True),
        StructField("chunked_us", LongType(), False),  # the version whose chunks hold this text
    ]
)
VERSION_SCHEMA = StructType(
    [
        StructField("doc_id", LongType(), False),
        StructField("modified_us", LongType(), False),
        StructField("doc_hash", StringType(), True),
        StructField("text", StringType(), True),
    ]
)
CHUNK_SCHEMA = StructType(
    [
        StructField("node_id", StringType(), False),
        StructField("doc_id", LongType(), False),
        StructField("chunk_no", LongType(), True),
        StructField("text", StringType(), True),
        StructField("n_tokens", LongType(), True),
        StructField("modified_us", LongType(), False),
        StructField("doc_hash", StringType(), True),
    ]
)
STREAM_CONF = {
    # keyed state needs this provider; it keeps entries on disk, not in the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # expiry asks for batches without data for ever, and "all that is there" would never end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
ONE_BATCH_CONF = {
    # a run of one batch leaves no open stores, with their preallocated files, on the executors
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
BEFORE_ALL = -(2**63)


def order(at: int, doc_hash: str | None) -> tuple[int, str]:
    return at, doc_hash or ""


class LatestVersion(StatefulProcessor):
    """Keeps the newest version's entry of one document and yields it if its text is new."""

    def __init__(self, expire_after_ms: int | None):
        self.expire_after_ms = expire_after_ms

    def init(self, handle) -> None:
        self.entry = handle.getValueState("entry", ENTRY_SCHEMA, self.expire_after_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = None
        for r in rows:
            if newest is None or order(r.modified_us, r.doc_hash) > order(newest.modified_us, newest.doc_hash):
                newest = r
        if newest is None:
            return
        at, doc_hash = newest.modified_us, newest.doc_hash
        old = self.entry.get() if self.entry.exists() else None
        if old is not None:
            old_at, old_hash, chunked = old
            if order(at, doc_hash) < order(old_at, old_hash):
                return
            if doc_hash == old_hash:  # the time, and the expiry, move on
                self.entry.update((at, doc_hash, chunked))
                return
        self.entry.update((at, doc_hash, at))
        yield Row(doc_id=key[0], modified_us=at, doc_hash=doc_hash, text=newest.text)

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings while a query starts (it keeps a copy), put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StateIngest:
    """Chunk log and state under ``root`` (shared storage on a cluster)."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        chunker: Callable[[DataFrame], DataFrame] = ingest.chunker_256,
        id_type: DataType = LongType(),
        expire_after_ms: int | None = None,
    ):
        self.input_schema, self.version_schema, self.chunk_schema = (with_id_type(s, id_type) for s in (INPUT_SCHEMA, VERSION_SCHEMA, CHUNK_SCHEMA))
        self.spark = spark
        self.root = root.rstrip("/")
        self.chunks_path = f"{self.root}/chunks"
        self.checkpoint = f"{self.root}/_checkpoint"
        self.chunker = chunker
        self.expire_after_ms = expire_after_ms

    # ---------------------------------------------------------------- read side
    def registry(self) -> DataFrame:
        """(doc_id, modified_at, doc_hash, chunked_us) of the last committed batch."""
        if not self._committed():
            empty = StructType([self.version_schema["doc_id"], *ENTRY_SCHEMA.fields])
            entries = self.spark.createDataFrame([], empty)
        else:
            rows = self.spark.read.format("statestore").option("stateVarName", "entry").load(self.checkpoint)
            if self.expire_after_ms:
                rows = rows.where(F.col("value.ttlExpirationMs") > F.unix_millis(F.current_timestamp())).select("key", F.col("value.value").alias("value"))
            entries = rows.select("key.doc_id", "value.*")
        at = F.when(F.col("modified_us") != BEFORE_ALL, F.timestamp_micros("modified_us"))
        return entries.select("doc_id", at.alias("modified_at"), "doc_hash", "chunked_us")

    def current_chunks(self) -> DataFrame:
        """Chunks of the current version of every document."""
        chunks = ingest.load_or_empty(self.spark, self.chunks_path, self.chunk_schema)
        entry = self.registry().select(F.col("doc_id").alias("_id"), F.col("chunked_us").alias("_at"), F.col("doc_hash").alias("_hash"))
        same = (F.col("doc_id") == F.col("_id")) & (F.col("modified_us") == F.col("_at")) & F.col("doc_hash").eqNullSafe(F.col("_hash"))
        return chunks.join(entry, same, "left_semi").select("node_id", "doc_id", "chunk_no", "text", "n_tokens")

    def _committed(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/commits")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p) and any(st.getPath().getName().isdigit() for st in fs.listStatus(p))

    # --------------------------------------------------------------- write side
    def accepted(self, docs: DataFrame) -> DataFrame:
        """The new and changed versions among streamed ``docs`` (doc_id, modified_at, text)."""
        versions = docs.where(F.col("doc_id").isNotNull()).select(
            "doc_id", F.coalesce(F.unix_micros("modified_at"), F.lit(BEFORE_ALL)).alias("modified_us"), F.sha2("text", 256).alias("doc_hash"), "text"
        )
        time_mode = "ProcessingTime" if self.expire_after_ms else "None"
        return versions.groupBy("doc_id").transformWithState(LatestVersion(self.expire_after_ms), self.version_schema, "Update", time_mode)

    def write_batch(self, versions: DataFrame, batch_id: int) -> None:
        """One pass: the state is asked once per batch, and its rows are chunked as they come."""
        names = [f.name for f in self.chunk_schema.fields]
        self.chunker(versions).select(*names).write.mode("overwrite").parquet(f"{self.chunks_path}/batch_id={batch_id}")

    def run(self, drop_dir: str, files_per_batch: int | None = None, available_now: bool = True):
        """Process the drop folder; with ``available_now`` it stops when caught up."""
        one_batch = available_now and not files_per_batch
        with settings(self.spark, {**STREAM_CONF, **(ONE_BATCH_CONF if one_batch else {})}):
            stream = self.spark.readStream.schema(self.input_schema)
            if files_per_batch:
                stream = stream.option("maxFilesPerTrigger", files_per_batch)
            out = self.accepted(stream.parquet(drop_dir)).writeStream.outputMode("update")
            w = out.foreachBatch(self.write_batch).option("checkpointLocation", self.checkpoint)
            q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
        if available_now:
            q.awaitTermination()
        return q
