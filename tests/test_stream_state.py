"""Keyed streaming state: the winners of ``StreamIngest``, restarts and expiry."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql.types import StringType

from quarry.operators import ingest
from quarry.streaming.ingest_state import STREAM_CONF, StateIngest
from quarry.streaming.ingest_stream import StreamIngest

DAY = dt.datetime(2026, 1, 1)


def arrive(spark, job, drop, *rows):
    """One file, in nullable columns: a drop folder may hold anything."""
    schema = f"doc_id {job.input_schema['doc_id'].dataType.simpleString()}, modified_at timestamp, text string"
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(drop)


def texts(job):
    return {r.doc_id: r.text for r in job.current_chunks().collect()}


def versions(job):
    return {tuple(r) for r in job.registry().select("doc_id", "modified_at", "doc_hash").collect()}


def test_random_arrivals_end_as_in_the_log_based_stream(spark, tmp_path):
    rng = random.Random(5)
    state, log = StateIngest(spark, str(tmp_path / "state")), StreamIngest(spark, str(tmp_path / "log"))
    drop = str(tmp_path / "drop")
    assert texts(state) == {} and state.registry().count() == 0
    for _ in range(3):  # repeated ids, equal times, older versions and equal texts, within and across batches
        rows = [(rng.randrange(12), DAY + dt.timedelta(days=rng.randrange(4)), rng.choice(["a b", "c d e", "f", "", None])) for _ in range(15)]
        arrive(spark, state, drop, *rows)
        state.run(drop)
        log.run(drop)
        assert versions(state) == versions(log)
        got, want = (sorted(map(tuple, j.current_chunks().collect())) for j in (state, log))
        assert got == want and got
    assert all(spark.conf.get(k, None) != v for k, v in STREAM_CONF.items())  # put back


def test_unchanged_text_is_not_chunked_again_and_odd_rows(spark, tmp_path):
    job, drop = StateIngest(spark, str(tmp_path / "s"), id_type=StringType()), str(tmp_path / "drop")
    arrive(spark, job, drop, ("a", DAY, "one"), ("b", None, "no time"), (None, DAY, "no id"), ("c", DAY, None))
    job.run(drop)
    assert texts(job) == {"a": "one", "b": "no time"}
    assert {(r.doc_id, r.modified_at) for r in job.registry().collect()} == {("a", DAY), ("b", None), ("c", DAY)}
    arrive(spark, job, drop, ("a", DAY + dt.timedelta(days=2), "one"), ("b", DAY, "timed"))
    job.run(drop)
    arrive(spark, job, drop, ("a", DAY + dt.timedelta(days=1), "late"))
    job.run(drop)
    assert texts(job) == {"a": "one", "b": "timed"}
    assert spark.read.parquet(job.chunks_path).where("doc_id = 'a'").count() == 1


def test_a_batch_that_fails_after_its_write_is_replayed(spark, tmp_path):
    root, drop = str(tmp_path / "s"), str(tmp_path / "drop")
    job = StateIngest(spark, root)
    arrive(spark, job, drop, (1, DAY, "one"), (2, DAY, "two"))
    job.run(drop)
    arrive(spark, job, drop, (1, DAY + dt.timedelta(days=1), "one again"), (3, DAY, "three"))

    class Broken(StateIngest):
        def write_batch(self, versions, batch_id):
            super().write_batch(versions, batch_id)
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        Broken(spark, root).run(drop)
    assert spark.read.parquet(job.chunks_path).count() == 4
    assert texts(job) == {1: "one", 2: "two"}  # the batch is not committed
    again = StateIngest(spark, root)
    again.run(drop)
    assert texts(again) == {1: "one again", 2: "two", 3: "three"}
    assert spark.read.parquet(job.chunks_path).count() == 4


def test_entries_expire_unless_they_arrive_again(spark, tmp_path):
    drop = str(tmp_path / "drop")
    job = StateIngest(spark, str(tmp_path / "s"), expire_after_ms=12_000)
    arrive(spark, job, drop, (1, DAY, "one"), (2, DAY, "two"))
    job.run(drop)
    first = time.time()
    assert texts(job) == {1: "one", 2: "two"}
    arrive(spark, job, drop, (2, DAY, "two"))  # the same version keeps its entry alive
    time.sleep(max(0.0, first + 5 - time.time()))
    job.run(drop)
    time.sleep(max(0.0, first + 12.5 - time.time()))
    assert texts(job) == {2: "two"}
    arrive(spark, job, drop, (1, DAY - dt.timedelta(days=1), "one older"))  # forgotten, hence new
    job.run(drop)
    assert texts(job)[1] == "one older"


def test_chunker_reads_the_state_once(spark, tmp_path):
    calls = []

    def chunker(docs):
        calls.append(docs.isStreaming)
        return ingest.chunker_256(docs)

    job, drop = StateIngest(spark, str(tmp_path / "s"), chunker), str(tmp_path / "drop")
    arrive(spark, job, drop, (1, DAY, "one"))
    job.run(drop)
    assert calls == [False] and texts(job) == {1: "one"}
