from pyspark.sql import functions as F

from quarry.operators import ingest


def test_upsert_semantics(spark):
    chunks0 = ingest.chunker_256(spark.createDataFrame([(1, "same text"), (2, "old text"), (3, "kept text")], "doc_id long, text string"))
    state = spark.createDataFrame([(1, "same text"), (2, "old text"), (3, "kept text")], "doc_id long, text string").select(
        "doc_id", F.sha2("text", 256).alias("doc_hash"))
    incoming = spark.createDataFrame([(1, "same text"), (2, "new text"), (4, "brand new")], "doc_id long, text string")
    cls = {r["doc_id"]: r["status"] for r in ingest.classify(incoming, state).collect()}
    assert cls == {1: "unchanged", 2: "changed", 4: "new"}
    chunks, new_state, delta = ingest.upsert(chunks0, state, incoming, ingest.chunker_256)
    texts = {r["doc_id"]: r["text"] for r in chunks.collect()}
    assert texts == {1: "same text", 2: "new text", 3: "kept text", 4: "brand new"}
    assert sorted(r["doc_id"] for r in delta.collect()) == [2, 4]
    assert new_state.count() == 4


def test_noop_ingest_has_empty_delta(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    state = docs.select("doc_id", F.sha2("text", 256).alias("doc_hash"))
    chunks0 = ingest.chunker_256(docs)
    chunks, _, delta = ingest.upsert(chunks0, state, docs, ingest.chunker_256)
    assert delta.count() == 0
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, chunks0.collect()))


def test_noop_ingest_exchanges_no_texts(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(40)], "doc_id long, text string")
    state = docs.select("doc_id", F.sha2("text", 256).alias("doc_hash"))
    chunks, _, _ = ingest.upsert(ingest.chunker_256(docs), state, docs, ingest.chunker_256)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert chunks.count() == 40


def test_cache_hits_and_misses(spark):
    prev = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string").withColumn("input_hash", F.sha2("text", 256))
    cache = ingest.chunker_256(prev).select("input_hash", F.lit("t").alias("transform_id"), "chunk_no", "text")
    inc = spark.createDataFrame([(9, "alpha beta"), (10, "gamma")], "doc_id long, text string")
    hits, misses = ingest.cache_lookup(inc, cache, "t")
    assert [r["doc_id"] for r in hits.collect()] == [9]
    assert [r["doc_id"] for r in misses.collect()] == [10]
    out, new_entries = ingest.cached_transform(inc, cache, "t", ingest.chunker_256)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(9, "alpha beta"), (10, "gamma")]
    assert new_entries.count() == 1


def test_enrich_and_dedup(spark):
    d = spark.createDataFrame([(1, "rag.txt", "x"), (2, "python.txt", "x"), (3, None, "y")], "doc_id long, file_name string, text string")
    e = {r["doc_id"]: (r["source"], r["document_name"], r["category"]) for r in ingest.enrich(d).collect()}
    assert e == {1: ("local_documents", "rag.txt", "rag"), 2: ("local_documents", "python.txt", "python"),
                 3: ("local_documents", None, "general")}
    dd = {r["doc_id"]: r["n_copies"] for r in ingest.dedup_exact(d).collect()}
    assert dd == {1: 2, 3: 1}


def test_load_or_empty(spark, tmp_path):
    df = ingest.load_or_empty(spark, str(tmp_path / "missing"), ingest.DOC_STATE_SCHEMA)
    assert df.count() == 0 and df.schema == ingest.DOC_STATE_SCHEMA


def test_upsert_keeps_state_columns(spark):
    import datetime as dt

    state = spark.createDataFrame([(1, "x", dt.datetime(2026, 1, 1))], "doc_id long, doc_hash string, modified_at timestamp")
    chunks0 = ingest.chunker_256(spark.createDataFrame([(1, "old")], "doc_id long, text string"))
    inc = spark.createDataFrame([(1, "new", dt.datetime(2026, 2, 1)), (2, "other", None)], "doc_id long, text string, modified_at timestamp")
    _, new_state, _ = ingest.upsert(chunks0, state, inc, ingest.chunker_256)
    got = {r["doc_id"]: r["modified_at"] for r in new_state.collect()}
    assert got == {1: dt.datetime(2026, 2, 1), 2: None}


def test_upsert_dedups_incoming_by_id(spark):
    import datetime as dt

    state = spark.createDataFrame([], "doc_id long, doc_hash string")
    chunks0 = ingest.chunker_256(spark.createDataFrame([], "doc_id long, text string"))
    inc = spark.createDataFrame([(1, "older", dt.datetime(2026, 1, 1)), (1, "newer", dt.datetime(2026, 1, 2))],
                                "doc_id long, text string, modified_at timestamp")
    chunks, _, _ = ingest.upsert(chunks0, state, inc, ingest.chunker_256)
    assert [r["text"] for r in chunks.collect()] == ["newer"]


def test_text_that_becomes_null_is_changed(spark):
    from quarry.operators import ingest

    state = ingest.classify(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, doc_hash string"))
    assert {r.status for r in state.collect()} == {"new"}
    again = spark.createDataFrame([(1, None), (2, None), (3, "c"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.status for r in ingest.classify(again, state.select("doc_id", "doc_hash")).collect()}
    assert got == {1: "changed", 2: "unchanged", 3: "unchanged", 4: "new"}
