"""Plan-shape tests: the physical plans we want at scale."""

import contextlib
import io

from conftest import SF0001

from quarry.plans import eval_plans, hybrid_plans, sparse, tree_plans

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_bm25_plan(spark):
    p = plan(sparse.bm25_topk(spark, SF0001))
    assert "WindowGroupLimit" in p  # per-query top-k limited before the exchange
    assert "BroadcastHashJoin" in p  # query side broadcast behind its size check
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p  # column pruning
    assert not any(n in p for n in PY_NODES)


def test_no_python_in_fusion_merge_eval(spark):
    for df in (tree_plans.automerge_full(spark, SF0001), eval_plans.eval_summary(spark, SF0001)):
        p = plan(df)
        assert not any(n in p for n in PY_NODES)


def test_dense_scoring_is_batched(spark):
    p = plan(hybrid_plans.hybrid_fused_rerank(spark, SF0001))
    assert "MapInPandas" in p  # Arrow batches, one matrix product per batch
    assert "BroadcastNestedLoopJoin" not in p  # no all-pairs join
    assert not any(n in p for n in PY_NODES)


def test_no_cross_joins_or_row_udfs_in_any_registered_query(spark):
    import __spark_entry__ as entry

    bad = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")
    for name, fn in entry.queries().items():
        if name in ("stream_ingest", "stream_ingest_state", "collection_roundtrip", "collection_source"):  # run writes while planning
            continue
        p = plan(fn(spark, SF0001))
        assert not [b for b in bad if b in p], name
