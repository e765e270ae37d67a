"""Incremental ingestion over versioned tables.

Registry, chunks and transformation cache are tables of one version
(``quarry.sources.versions``), so a reader never sees the registry of one run with the
chunks of another, and a run that dies changes nothing.

- ``state`` (doc_id, doc_hash, run): narrow, written anew by each run.
- ``chunks`` (doc_id, run, node_id, ...): a run adds the chunks of new and changed documents.
  Stored chunks are not rewritten: a document's chunks are those of the run its
  ``state`` row names.
- ``cache`` (input_hash, transform_id, chunk_no, ...): the chunks of each text that was
  ever transformed, by content; a text is transformed once, however many documents
  or runs bring it.  A row without ``chunk_no`` stands for a text without chunks.

``compact`` drops the chunks no document refers to any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ingest import with_status
from quarry.operators.topk import store, top_k
from quarry.sources.versions import Snapshot, Versions


class IngestStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def open(self, version: int | None = None) -> Snapshot:
        return self.versions.open(version)

    def chunks(self, snapshot: Snapshot) -> DataFrame:
        """The chunks of the documents of a version."""
        live = snapshot.read(self.spark, "state").select("doc_id", "run")
        return snapshot.read(self.spark, "chunks").join(live, ["doc_id", "run"]).drop("run")

    def run(self, incoming: DataFrame, chunker: Callable[[DataFrame], DataFrame], transform_id: str) -> Snapshot:
        """Ingest ``incoming`` (doc_id, text, optional modified_at) and publish the next version.

        ``chunker`` maps (doc_id, text) rows to (doc_id, node_id, chunk_no, ...).
        Of several rows of one id the newest counts (equal times: greatest content
        hash).  Documents that are not sent are kept.
        """
        base = self.versions.open()
        run = base.version + 1
        order = [F.col("modified_at").desc_nulls_last()] if "modified_at" in incoming.columns else []
        hashed = incoming.select(*incoming.columns, F.sha2("text", 256).alias("doc_hash"))
        newest = top_k(hashed.drop("text"), ["doc_id"], [*order, F.col("doc_hash").desc_nulls_last()], 1, "_n").select("doc_id", "doc_hash")
        if base.version:
            state = base.read(self.spark, "state")
        else:
            state = newest.limit(0).withColumn("run", F.lit(0).cast("long"))
        todo = store(with_status(newest, state).where("status <> 'unchanged'").select("doc_id", "doc_hash", F.coalesce("doc_hash", F.sha2(F.lit(""), 256)).alias("input_hash")), "ingest-todo")

        # a text is looked up, and transformed, by its content
        inputs = todo.select("input_hash").distinct()
        known = base.read(self.spark, "cache").where(F.col("transform_id") == transform_id) if "cache" in base.tables else None
        missing = inputs if known is None else inputs.join(known.select("input_hash").distinct(), "input_hash", "left_anti")
        texts = hashed.select(F.coalesce("doc_hash", F.sha2(F.lit(""), 256)).alias("input_hash"), "text").join(missing, "input_hash", "left_semi").dropDuplicates(["input_hash"])
        made = chunker(texts.select(F.col("input_hash").alias("doc_id"), "text")).drop("node_id")
        entries = missing.join(made.withColumnRenamed("doc_id", "input_hash"), "input_hash", "left").withColumn("transform_id", F.lit(transform_id))
        cache = self.versions.write("cache", entries.select("input_hash", "transform_id", *[c for c in made.columns if c != "doc_id"]))
        fresh = Snapshot(0, {"cache": cache}).read(self.spark, "cache")
        usable = fresh if known is None else known.select(*fresh.columns).unionByName(fresh)

        delta = todo.select("doc_id", "input_hash").join(usable.where(F.col("chunk_no").isNotNull()), "input_hash").drop("input_hash", "transform_id")
        node = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))
        chunks = self.versions.write("chunks", delta.withColumn("node_id", node).withColumn("run", F.lit(run).cast("long")))
        kept = state.join(todo.select("doc_id"), "doc_id", "left_anti").select("doc_id", "doc_hash", "run")
        new_state = self.versions.write("state", kept.unionByName(todo.select("doc_id", "doc_hash", F.lit(run).cast("long").alias("run"))))
        tables = {"state": new_state, "chunks": self.versions.appended(base, "chunks", chunks), "cache": self.versions.appended(base, "cache", cache)}
        return self.versions.publish(base, tables)

    def compact(self) -> Snapshot:
        """The same documents with one file set of chunks, without those of replaced versions."""
        base = self.versions.open()
        live = base.read(self.spark, "state").select("doc_id", "run")
        return self.versions.publish(base, {"chunks": self.versions.write("chunks", base.read(self.spark, "chunks").join(live, ["doc_id", "run"], "left_semi"))})
