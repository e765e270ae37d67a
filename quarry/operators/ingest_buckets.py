"""Upserts against bucketed tables: stored rows are never shuffled.

``state`` (doc_id, doc_hash, run) and ``chunks`` (run, the chunker's columns) are stored in
the same number of buckets of ``doc_id``.  A run brings its own rows into that
partitioning - one shuffle of what arrives - and joins them to the stored tables where
these lie:

* classify: newest incoming versions left join ``state``;
* kept registry rows: ``state`` left anti join the changed documents;
* reading: ``chunks`` joined to ``state`` by document and run, without a shuffle at all.

``state`` is narrow and written anew by a run.  Chunks are only appended; a document's
chunks are those of the run its ``state`` row names, so a run that dies leaves rows
nobody reads.  State and chunks become visible together, with the version's manifest
(``quarry.sources.versions``).  ``compact`` drops the chunks no document refers to.

Buckets are set when a store is created: choose their number so that one bucket of
``chunks`` fits a task.  The tables' folders are below ``root``; the session's catalog
only names them.  A null id is no document; a null text is one without chunks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.operators.ingest import with_status
from quarry.operators.topk import store, top_k
from quarry.sources.versions import Snapshot, Versions


class BucketedIngest:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.versions = spark, Versions(spark, root)
        self.buckets = self.versions.open().values.get("buckets", buckets)

    def open(self, version: int | None = None) -> Snapshot:
        return self.versions.open(version)

    def table(self, snapshot: Snapshot, name: str) -> DataFrame:
        """A stored table with its bucketing, in any session."""
        schema, (path,) = snapshot.tables[name]
        self._register(StructType.fromJson(json.loads(schema)), path)
        return self.spark.table(self._named(path))

    def chunks(self, snapshot: Snapshot) -> DataFrame:
        """The chunks of the documents of a version."""
        return self._live(snapshot).drop("run")

    def _live(self, snapshot: Snapshot) -> DataFrame:
        chunks = self.table(snapshot, "chunks")
        state = self.table(snapshot, "state").select(F.col("doc_id").alias("_id"), F.col("run").alias("_run"))
        # two bounds and not an equality: with ``run`` as a join key the buckets of doc_id would not do
        same_run = (F.col("run") >= F.col("_run")) & (F.col("run") <= F.col("_run"))
        return chunks.join(state, (F.col("doc_id") == F.col("_id")) & same_run, "left_semi")

    def classify(self, incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
        """(doc_id, doc_hash, status) of the newest version per incoming document.

        Newest by ``modified_at`` if there is one, equal times by content hash.
        """
        order = [F.col("modified_at").desc_nulls_last()] if "modified_at" in incoming.columns else []
        narrow = incoming.where(F.col("doc_id").isNotNull()).withColumn("doc_hash", F.sha2("text", 256)).drop("text")
        newest = top_k(narrow.repartition(self.buckets, "doc_id"), ["doc_id"], [*order, F.col("doc_hash").desc_nulls_last()], 1, "_n").select("doc_id", "doc_hash")
        if not snapshot.version:
            return newest.withColumn("status", F.lit("new"))
        return with_status(newest, self.table(snapshot, "state"))

    def run(self, incoming: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> Snapshot:
        """Ingest ``incoming`` (doc_id, text, optional modified_at); documents not sent are kept."""
        base, run = self.versions.open(), uuid.uuid4().hex
        todo = store(self.classify(incoming, base).where("status <> 'unchanged'").select("doc_id", "doc_hash"), "bucket-todo")
        wanted = todo.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"))
        same = (F.col("doc_id") == F.col("_id")) & F.col("doc_hash").eqNullSafe(F.col("_hash"))
        hashed = incoming.select("doc_id", "text", F.sha2("text", 256).alias("doc_hash"))
        texts = hashed.join(wanted, same, "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
        delta = chunker(texts).withColumn("run", F.lit(run))
        chunks = self._write("chunks", delta, base.tables["chunks"][1][0] if base.version else None)
        fresh = todo.repartition(self.buckets, "doc_id").withColumn("run", F.lit(run))
        if base.version:
            state = self.table(base, "state")
            fresh = state.join(fresh.select("doc_id"), "doc_id", "left_anti").select("doc_id", "doc_hash", "run").unionByName(fresh)
        return self.versions.publish(base, {"state": self._write("state", fresh), "chunks": chunks}, {"buckets": self.buckets})

    def compact(self) -> Snapshot:
        """The same documents, with one file per bucket and no chunks of replaced versions."""
        base = self.versions.open()
        return self.versions.publish(base, {"chunks": self._write("chunks", self._live(base))})

    def _write(self, name: str, df: DataFrame, path: str | None = None) -> tuple[str, tuple[str, ...]]:
        """Rows as a new bucketed table, or appended to the one at ``path``; one file per bucket and write."""
        schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])
        path = path or f"{self.versions.root}/data/{name}-{uuid.uuid4().hex}"
        self._register(schema, path)
        columns = self.spark.table(self._named(path)).columns
        rows = df.repartition(self.buckets, "doc_id").select(*columns)
        rows.write.mode("append").insertInto(self._named(path))
        return schema.json(), (path,)

    def _register(self, schema: StructType, path: str) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spec = f"CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._named(path)} ({columns}) USING parquet {spec} LOCATION '{path}'")

    @staticmethod
    def _named(path: str) -> str:
        return "quarry_" + path.rsplit("/", 1)[1].replace("-", "_")
