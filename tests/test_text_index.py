import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, ingest
from quarry.operators import text_index as tix
from quarry.operators.ingest_store import IngestStore
from quarry.session import work_path
from quarry.sources.versions import Conflict, Versions

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40))) for i in range(n)}


def frame(spark, docs, ids="long"):
    return spark.createDataFrame(list(docs.items()), f"node_id {ids}, text string")


def queries(spark, n=15, seed=9):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))) for i in range(n)] + [(99, "nowhere"), (98, ""), (97, None)], "query_id long, text string")


def hits(df):
    return sorted((r.query_id, r.node_id, round(r.score, 9), r["rank"]) for r in df.collect())


def plain(spark, docs, k=3, **kw):
    return hits(bm25.bm25_topk(queries(spark), frame(spark, docs, kw.pop("ids", "long")), k, **kw))


@pytest.mark.parametrize("block_rows", [1, 7, 512])
def test_same_rows_as_the_scan_for_any_block_size(spark, block_rows):
    docs = corpus(150, 1)
    root = work_path(spark, "ix")
    tix.build(frame(spark, docs), root, block_rows=block_rows)
    assert hits(tix.topk(queries(spark), tix.open_index(spark, root), 3)) == plain(spark, docs)


def test_variant_stopwords_ties_and_string_ids(spark):
    docs = {f"d/{i}": t for i, t in corpus(60, 2).items()}
    docs.update({f"same/{i}": "w1 w2 w3 w40" for i in range(30)})
    root = work_path(spark, "ix")
    index = tix.build(frame(spark, docs, "string"), root, block_rows=5, stopwords=["w0", "w1"])
    want = lambda: plain(spark, docs, ids="string", stopwords=["w0", "w1"], plus_one=False)
    assert hits(tix.topk(queries(spark), index, 3, plus_one=False)) == want()
    docs["d/3"] = "w0 w0 w40 w7"
    after = tix.upsert(root, frame(spark, {"d/3": docs["d/3"]}, "string"))
    assert hits(tix.topk(queries(spark), after, 3, plus_one=False)) == want()


def test_blocks_are_skipped(spark):
    docs = {i: "common filler words " + "x" * (i % 7) + " common" * (i % 5) for i in range(2000)}
    docs.update({5000 + i: "common rare jewel" for i in range(6)})
    index = tix.build(frame(spark, docs), work_path(spark, "ix"), block_rows=50)
    q = spark.createDataFrame([(1, "common rare jewel")], "query_id long, text string")
    found, read = tix.search(q, index, 3)
    want = hits(bm25.bm25_topk(q, frame(spark, docs), 3))
    assert hits(found) == want and [w[1] for w in want] == [5000, 5001, 5002]
    assert read.agg(F.sum("n")).first()[0] < 200  # of 2018 postings
    per_block = index.table("postings").selectExpr("max(size(entries)) m", "min(n - size(entries)) d").first()
    assert per_block.m <= 50 and per_block.d == 0


def test_bounds_of_blocks(spark):
    index = tix.build(frame(spark, corpus(80, 3)), work_path(spark, "ix"), block_rows=4)
    for r in index.table("postings").collect():
        assert r.n == len(r.entries) and r.max_tf == max(e.tf for e in r.entries) and r.min_dl == min(e.dl for e in r.entries)


def test_upserts_deletes_and_merge_equal_a_rebuild(spark):
    docs, root = corpus(120, 4), work_path(spark, "ix")
    tix.build(frame(spark, docs), root, block_rows=9)
    first = {i: t + " w5 new" for i, t in list(docs.items())[:30]} | {500: "w3 w3 w50", 501: ""}
    tix.upsert(root, frame(spark, first), spark.createDataFrame([(40,), (41,), (777,), (3,)], "node_id long"))
    docs = {**{i: t for i, t in docs.items() if i not in (40, 41)}, **first}
    before = tix.open_index(spark, root)
    assert hits(tix.topk(queries(spark), before, 3)) == plain(spark, docs)
    held, reader = dict(docs), before
    second = {0: "w0 w1", 40: "w2 w59", 500: "w9"}  # changed twice, deleted and back
    tix.upsert(root, frame(spark, second), spark.createDataFrame([(501,), (50,)], "node_id long"))
    docs = {**{i: t for i, t in docs.items() if i not in (501, 50)}, **second}
    after = tix.open_index(spark, root)
    want = plain(spark, docs)
    assert hits(tix.topk(queries(spark), after, 3)) == want and after.n_docs == len(docs)
    merged = tix.merge(spark, root)
    assert hits(tix.topk(queries(spark), merged, 3)) == want
    assert merged.table("dead").count() == merged.table("minus").count() == 0 and merged.table("docs").count() == len(docs)
    # a reader opened before keeps its rows
    assert hits(tix.topk(queries(spark), reader, 3)) == plain(spark, held)


def test_a_second_build_replaces_the_first(spark):
    root = work_path(spark, "ix")
    with pytest.raises(LookupError):
        tix.open_index(spark, root)
    tix.build(frame(spark, corpus(30, 5)), root)
    docs = {1: "w1 w2", 2: None, 3: "w2"}
    tix.build(frame(spark, docs), root)
    index = tix.open_index(spark, root)
    assert (index.snapshot.version, index.n_docs) == (2, 3) and hits(tix.topk(queries(spark), index, 3)) == plain(spark, docs)
    assert tix.open_index(spark, root, 1).n_docs == 30
    with pytest.raises(Conflict):
        Versions(spark, root).publish(tix.open_index(spark, root, 1).snapshot, {})


def test_empty_tables_and_repeated_ids(spark):
    root = work_path(spark, "ix")
    empty = tix.build(frame(spark, {1: "a"}).limit(0), root)
    assert tix.topk(queries(spark), empty, 3).count() == 0
    tix.upsert(root, frame(spark, {1: "w1 w2"}))
    tix.upsert(root, spark.createDataFrame([(2, "w1"), (2, "w1 w1 w1"), (2, None)], "node_id long, text string"))
    assert hits(tix.topk(queries(spark), tix.open_index(spark, root), 3)) == plain(spark, {1: "w1 w2", 2: "w1 w1 w1"})
    assert tix.topk(queries(spark).limit(0), tix.open_index(spark, root), 3).count() == 0


def texts(st, snapshot):
    return sorted((r.doc_id, r.chunk_no, r.text, r.node_id) for r in st.chunks(snapshot).collect())


def test_ingest_store_runs_versions_and_cache(spark):
    st = IngestStore(spark, work_path(spark, "store"))
    calls = []

    def chunker(df):
        calls.append(df.select("text"))
        return ingest.chunker_256(df)

    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    one = st.run(rows((1, "a b"), (2, "c"), (3, "a b"), (4, ""), (5, None)), chunker, "t")
    reader = st.open()
    assert texts(st, one) == [(1, 0, "a b", "1/0"), (2, 0, "c", "2/0"), (3, 0, "a b", "3/0")]
    assert calls[0].where("text = 'a b'").count() == 1  # equal texts are transformed once
    two = st.run(rows((1, "a b"), (2, "d"), (6, "c"), (6, "c"), (4, None)), chunker, "t")
    assert sorted(r.text for r in calls[1].collect()) == ["d"]  # 'c' comes from the cache, though its document has gone
    assert texts(st, two) == [(1, 0, "a b", "1/0"), (2, 0, "d", "2/0"), (3, 0, "a b", "3/0"), (6, 0, "c", "6/0")]
    assert texts(st, reader) == texts(st, one)
    other = st.run(rows((7, "d")), chunker, "other transformation")
    assert calls[2].count() == 1 and other.version == 3
    small = st.compact()
    assert texts(st, small) == texts(st, other) and len(small.tables["chunks"][1]) == 1
    again = st.run(rows((1, "a b"), (2, "d")), chunker, "t")
    assert calls[3].count() == 0 and texts(st, again) == texts(st, other)


def test_ingest_store_newest_row_wins(spark):
    st = IngestStore(spark, work_path(spark, "store"))
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", None)], "doc_id long, text string, modified_at int")
    assert [t[2] for t in texts(st, st.run(rows, ingest.chunker_256, "t"))] == ["new", "x"]


def test_words_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a the"), (4, "a")], "node_id long, text string")
    out = tix.counted(docs, 7, "node_id", "text", ["the"])
    # one exchange, of whole rows by node_id; before, words were exchanged twice more
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.node_id: (r.segment, r.dl, sorted((t.term, t.n) for t in r.tf)) for r in out.collect()}
    assert got == {1: (7, 3, [("a", 1), ("b", 2)]), 2: (7, 0, []), 3: (7, 0, []), 4: (7, 1, [("a", 1)])}
