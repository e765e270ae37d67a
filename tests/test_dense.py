import numpy as np
import pytest

from quarry.operators import dense


def vecs(spark, n=60, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)], int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "node_id long, embedding array<float>, label int")


def brute(rows, k, exclude_self=True, same_label=False):
    out = {}
    for qi, qv, ql in rows:
        sc = []
        for ni, nv, nl in rows:
            if exclude_self and ni == qi:
                continue
            if same_label and nl != ql:
                continue
            a, b = np.asarray(qv, dtype=np.float64), np.asarray(nv, dtype=np.float64)
            sc.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), ni))
        out[qi] = [n for _, n in sorted(sc)[:k]]
    return out


def test_one_slice_and_many_agree_with_brute_force(spark):
    v = vecs(spark)
    q = v.withColumnRenamed("node_id", "query_id")
    rows = [(r[0], r[1], r[2]) for r in v.collect()]
    exp = brute(rows, 4)
    for kw in ({}, {"slice_bytes": 900}):
        got = dense.dense_topk(q, v, 4, exclude_self=True, **kw).collect()
        per = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            per.setdefault(r["query_id"], []).append(r["node_id"])
        assert per == exp


def test_exactly_k_rows_whatever_the_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5000)]
    v = spark.createDataFrame(rows, "node_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<double>")
    hits = dense._score_slice(
        q.selectExpr("query_id", "embedding as qv", "'' as qkey"), v.selectExpr("node_id", "embedding as nv", "'' as nkey"), 5, False
    )
    assert hits.count() == 15  # k per task
    assert [(r.node_id, r["rank"]) for r in dense.dense_topk(q, v, 5).orderBy("rank").collect()] == [(i, i + 1) for i in range(5)]


@pytest.mark.parametrize("names", [False, True])
@pytest.mark.parametrize("tile", [3, 4096])
def test_nearest_agrees_with_float64_on_ties_copies_and_repeated_ids(monkeypatch, names, tile):
    monkeypatch.setattr(dense, "TILE_NODES", tile)
    monkeypatch.setattr(dense, "MAX_CELLS", 50)
    monkeypatch.setattr(dense, "MAX_FOUND", 20)
    rng = np.random.default_rng(4)
    M = rng.normal(size=(60, 8))
    M[20:35] = M[3]  # copies
    M[35:45] = M[4] + 1e-6 * rng.normal(size=(10, 8))  # apart in float64 only
    M /= np.linalg.norm(M, axis=1, keepdims=True)
    M[50] = np.nan  # a zero vector
    ids = np.arange(60) % 57
    ids = np.array([f"n{i}" for i in ids], object) if names else ids
    best = dense.Nearest(ids.astype(object), M, 4, True)
    for i in range(0, 60, 25):
        best.add(np.arange(60), ids[i : i + 25], M[i : i + 25])
    got = sorted(zip(*(x.tolist() for x in best.rows())), key=lambda r: (r[0], -round(r[2], 9), r[1]))
    S, want = M @ M.T, []
    for q in range(60):
        hits = [(-round(S[q, n], 9), ids[n]) for n in range(60) if ids[n] != ids[q] and np.isfinite(S[q, n])]
        want += [(q, n, -score) for score, n in sorted(hits)[:4]]
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-9)


def test_recall_computes_either_list_once(spark):
    from quarry.operators import ann

    v = vecs(spark)
    q = v.withColumnRenamed("node_id", "query_id")
    approx = spark.createDataFrame([(0, 1), (0, 2), (5, 7)], "query_id long, node_id long")
    exact = dense.dense_topk(q, v, 4, exclude_self=True)
    got = ann.recall_at_k(approx, exact, 4)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    want = {i: 0.0 for i in range(60)}
    for r in exact.collect():
        want[r.query_id] += ((r.query_id, r.node_id) in {(0, 1), (0, 2), (5, 7)}) / 4
    assert {r.query_id: r.recall for r in got.collect()} == want


def test_string_ids_null_and_zero_vectors(spark):
    nodes = spark.createDataFrame([("12/3", [1.0, 1.0]), ("12/10", [1.0, 1.0]), ("a", [0.0, 0.0]), ("b", None), ("c", [-1.0, 0.0])], "node_id string, embedding array<double>")
    q = spark.createDataFrame([("q1", [1.0, 1.0]), ("q2", None), ("q3", [0.0, 0.0])], "query_id string, embedding array<double>")
    got = [(r.query_id, r.node_id, r["rank"]) for r in dense.dense_topk(q, nodes, 3).orderBy("query_id", "rank").collect()]
    assert got == [("q1", "12/10", 1), ("q1", "12/3", 2), ("q1", "c", 3)]
    pointers = nodes.where("node_id in ('12/3', 'c')").withColumnRenamed("node_id", "index_id")
    from quarry.operators import routing

    assert [tuple(r)[:2] for r in routing.first_hop(q, pointers).collect()] == [("q1", "12/3")]


def test_leaf_subset_search_by_vector(spark):
    """V5: dense search restricted to the leaves of a chunk tree."""
    from quarry.operators import chunking, embed

    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 60), (2, "omega psi chi phi " * 60)], "doc_id long, text string")
    leaves = chunking.leaf_nodes(chunking.chunk_tree(docs)).select("node_id", "text")
    q = embed.token_vectors(spark.createDataFrame([(7, "alpha gamma")], "query_id long, text string"), 64, "query_id")
    hits = dense.dense_topk(q, embed.token_vectors(leaves), 2).collect()
    assert len(hits) == 2 and all(r.node_id.startswith("1") for r in hits)


def test_match_restricts_to_collection(spark):
    v = vecs(spark)
    q = v.withColumnRenamed("node_id", "query_id")
    rows = [(r[0], r[1], r[2]) for r in v.collect()]
    exp = brute(rows, 3, same_label=True)
    got = dense.dense_topk(q, v, 3, exclude_self=True, match=("label", "label")).collect()
    per = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        per.setdefault(r["query_id"], []).append(r["node_id"])
    assert per == exp


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(dense.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(1 / np.sqrt(2))
    assert got[1] is None


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 1.0])], "k int, embedding array<double>")
    got = {r["k"]: r["embedding"] for r in dense.centroids(df, "k").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_ivf_with_tiny_slices_matches_exact_when_probing_all_cells(spark):
    from quarry.operators import ann

    v = vecs(spark, n=80)
    q = v.withColumnRenamed("node_id", "query_id")
    cells = ann.train_cells(v, n_cells=4, seed=7)
    approx = ann.ivf_topk(q, v, cells, k=3, nprobe=4, exclude_self=True, slice_rows=7)
    exact = dense.dense_topk(q, v, 3, exclude_self=True)
    a = sorted((r["query_id"], r["node_id"], r["rank"]) for r in approx.collect())
    b = sorted((r["query_id"], r["node_id"], r["rank"]) for r in exact.collect())
    assert a == b
