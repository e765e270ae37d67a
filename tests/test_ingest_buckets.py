"""Upserts against bucketed tables: rows of ``ingest.upsert``, and plans that leave stored rows where they are."""

import random
import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from quarry.operators import ingest
from quarry.operators.ingest_buckets import BucketedIngest
from quarry.sources.versions import Conflict
import pytest


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def chunk_rows(df):
    return sorted((r.doc_id, r.chunk_no, r.text) for r in df.collect())


@contextmanager
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def nodes_above_scans(df, table):
    """The operators between the root and each scan of a stored table."""
    text = df._jdf.queryExecution().executedPlan().toString()
    path, found = [], []
    for line in text.splitlines():
        depth = len(re.match(r"[\s:|+\-*()0-9]*", line).group())
        path = [(d, n) for d, n in path if d < depth] + [(depth, line)]
        if "Scan" in line and table in line:
            found.append([n for _, n in path])
    return found


@pytest.mark.parametrize("partitions", ["3", "40"])  # fewer and more than the buckets
def test_stored_side_is_not_exchanged(spark, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with no_broadcast(spark):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            job = BucketedIngest(spark, str(tmp_path / "b"), buckets=8)
            job.run(docs(spark, *[(i, f"text {i}") for i in range(200)]), ingest.chunker_256)
            snap = job.run(docs(spark, (3, "new text"), (900, "more")), ingest.chunker_256)
            for plan, tables in ((job.classify(docs(spark, (3, "x")), snap), ["quarry_state"]), (job.chunks(snap), ["quarry_state", "quarry_chunks"])):
                for t in tables:
                    paths = nodes_above_scans(plan, t)
                    assert paths and not any("Exchange" in n for p in paths for n in p)
            assert "Exchange" not in job.chunks(snap)._jdf.queryExecution().executedPlan().toString()
            assert len(chunk_rows(job.chunks(snap))) == 201
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_random_runs_give_the_rows_of_the_plain_upsert(spark, tmp_path):
    rng = random.Random(3)
    job = BucketedIngest(spark, str(tmp_path / "b"), buckets=4)
    state = spark.createDataFrame([], "doc_id long, doc_hash string")
    chunks = ingest.chunker_256(docs(spark)).limit(0)
    for _ in range(3):  # repeated ids, empty and null texts, unchanged ones
        rows = docs(spark, *[(rng.randrange(15), rng.choice(["a", "b c", "", None, "d " * 300])) for _ in range(12)])
        chunks, state, _ = ingest.upsert(chunks, state, rows, ingest.chunker_256)
        snap = job.run(rows, ingest.chunker_256)
        assert chunk_rows(job.chunks(snap)) == chunk_rows(chunks)
        got = {tuple(r) for r in job.table(snap, "state").select("doc_id", "doc_hash").collect()}
        assert got == {tuple(r) for r in state.select("doc_id", "doc_hash").collect()}
    assert chunk_rows(job.chunks(job.compact())) == chunk_rows(chunks)


def test_versions_failed_runs_and_other_sessions(spark, tmp_path):
    job = BucketedIngest(spark, str(tmp_path / "b"), buckets=4)
    first = job.run(docs(spark, (1, "one"), (2, "two"), (None, "no id")), ingest.chunker_256)
    reader = job.chunks(first)

    def broken(d):
        return ingest.chunker_256(d).withColumn("text", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))

    with pytest.raises(Exception, match="lost"):
        job.run(docs(spark, (1, "one b")), broken)
    second = job.run(docs(spark, (1, "one c")), ingest.chunker_256)
    assert second.version == 2
    assert [t for *_, t in chunk_rows(job.chunks(first))] == ["one", "two"] == [t for *_, t in chunk_rows(reader)]
    assert [t for *_, t in chunk_rows(job.chunks(second))] == ["one c", "two"]
    other = BucketedIngest(spark.newSession(), str(tmp_path / "b"), buckets=99)
    assert other.buckets == 4 and [t for *_, t in chunk_rows(other.chunks(other.open()))] == ["one c", "two"]
    with pytest.raises(Conflict):
        job.versions.publish(first, {})
    assert job.run(docs(spark), ingest.chunker_256).version == 3
