import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann_filter as af
from quarry.operators import ann_index as ax
from quarry.operators import dense
from quarry.operators.retrievers import metadata_filter


def corpus(spark, n=600, d=8):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=d)], None if i % 11 == 0 else int(rng.integers(3)), ["x", "y's", ""][i % 3], i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "node_id long, embedding array<double>, kind int, name string, even boolean")


@pytest.fixture(scope="module")
def tagged(spark):
    v = corpus(spark)
    index = ax.build(v, ax.train(v, n_cells=6, subspaces=4, codewords=16))
    return v, index, af.tag(index, v, ["kind", "name", "even"], part_rows=40, page=16)  # many pages per cell


@pytest.mark.parametrize(
    "filters", [{}, {"kind": 1}, {"kind": 1, "name": "y's"}, {"name": "", "even": True, "kind": 0}, {"kind": 1.5}, {"kind": 9}, {"kind": 1, "name": None}]
)
def test_filtered_rows_are_those_of_the_metadata_filter(tagged, filters):
    v, index, tags = tagged
    got = af.filtered(index, tags, filters)
    want = {r.node_id for r in metadata_filter(v, filters).select("node_id").collect()}
    assert sorted(r.node_id for r in got.codes.select("node_id").collect()) == sorted(want)
    assert {r.node_id for r in got.vectors.select("node_id").collect()} == want
    assert sum(got.sizes.values()) == len(want) and min(got.sizes.values(), default=1) > 0


def test_full_depth_under_a_filter_is_exact(tagged):
    v, index, tags = tagged
    filters = {"kind": 2, "even": False}
    q = v.select(F.col("node_id").alias("query_id"), "embedding")
    narrow = af.filtered(index, tags, filters)
    got = {tuple(r) for r in ax.search(q, narrow, ax.Depth(6, 600, 1.0), 4, exclude_self=True).select("query_id", "node_id", "rank").collect()}
    want = dense.dense_topk(q, metadata_filter(v, filters), 4, exclude_self=True).select("query_id", "node_id", "rank")
    assert got == {tuple(r) for r in want.collect()}


def test_cells_without_a_match_take_no_probe(tagged):
    v, index, tags = tagged
    one = af.filtered(index, tags, {"kind": 1})
    only = next(iter(one.sizes))
    single = ax.Index(one.codebook, one.codes.where(F.col("cell") == only), one.vectors, {only: one.sizes[only]})
    probes = ax.probed(v.select(F.col("node_id").alias("query_id"), "embedding"), single, 3, "query_id", "embedding")
    assert {r.cell for r in probes.select("cell").distinct().collect()} == {only}


def test_odd_columns_and_empty_tables(spark, tagged):
    v, index, tags = tagged
    with pytest.raises(ValueError):
        af.tag(index, v.withColumn("w", F.lit(1.0)), ["w"])
    with pytest.raises(KeyError):
        af.filtered(index, tags, {"other": 1})
    none = af.filtered(index, tags, {"kind": 9})
    q = v.select(F.col("node_id").alias("query_id"), "embedding")
    assert ax.choose_depth(q, none).probes == 1 and ax.search(q, none, ax.Depth(1, 5, 1.0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_holds_under_a_filter_of_one_percent(spark, sf):
    from quarry.plans.source_plans import ann_filtered_recall

    r = ann_filtered_recall(spark, f"/root/testdata/{sf}").first()
    assert r.n_queries > 0 and 0 < r.selectivity < 0.02 and r.mean_recall >= 0.9 and r.cells_with_match < r.cells
    print(r)
