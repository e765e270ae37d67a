import pytest
from conftest import SF0001
from test_decontaminate import brute as brute_leaks
from test_ngram_join import brute as brute_groups
from test_secrets import brute as brute_secrets

import corpus_pipeline as cp
from quarry.llm import decontaminate as dc
from quarry.llm import ngram_join as nj

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that enter each stage, and the last result."""
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF0001), "test-stage")
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns_and_clean_rows(spark, stages):
    columns = spark.read.parquet(f"{SF0001}/documents.parquet").columns
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == columns
    assert len(stages[1]) >= 0.97 * len(stages[0])  # all are prose in known languages
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]}


def test_one_of_each_group_stays(stages):
    before, after = stages[1], {r.doc_id for r in stages[2]}
    groups = brute_groups([(r.doc_id, r.text) for r in before], cp.SHINGLE_WORDS, cp.LEAST_SIMILARITY)
    assert after == {c for _, c in groups} and len(after) < len(before)


def test_documents_with_benchmark_passages_go(spark, stages):
    items = [(r.item_id, dc.tokens(r.text)) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    short = [r for r in stages[2] if len(r.text) < 5000]
    after = {r.doc_id for r in stages[3]}
    for r in short:
        assert (r.doc_id in after) == (not brute_leaks(r.text, items))


def test_secrets_are_redacted_and_other_texts_untouched(stages):
    before = {r.doc_id: r for r in stages[3]}
    for r in stages[4]:
        assert brute_secrets(r.text)[1] == ""
        if brute_secrets(before[r.doc_id].text)[1] == "":
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text)


def test_mix_meets_its_targets(stages):
    rows = stages[5]
    assert len(rows) == len(stages[4])
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), rel=0.05)
    assert all(r.taken <= 2 * r.size for r in rows)


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF0001).collect())) == sorted(map(tuple, stages[5]))


def test_edge_rows(spark):
    t = "the cat sat on the mat and the dog lay by the fire all day long"
    rows = [(1, t, "en", "a", 1), (1, t, "en", "a", 1), (2, t, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, t + " so", "en", None, 5), (5, "der hund und die katze und das haus am see im winter", "de", "a", 3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF0001), "test-edge")
    assert {r.doc_id for r in docs.collect()} == {1, 5}
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        empty = cp.stored(stage(spark, empty, SF0001), "test-empty")
    assert empty.count() == 0


def test_one_of_each_keeps_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "a b", "x"), (2, "a b", "y"), (3, "A b", "x")], "doc_id long, text string, component string")
    assert sorted(map(tuple, nj.one_of_each(docs).collect()), key=str) == [(1, None, "x"), (1, None, "x"), (2, "a b", "x")]
