"""Approximate nearest neighbours: inverted-file (IVF) search (V4).

1. ``KMeans`` (pyspark.ml, distributed) on unit vectors gives ``n_cells``
   centroids -- a small, bounded table.
2. Every corpus vector is assigned to its nearest cell (a per-row projection).
3. Every query probes its ``nprobe`` nearest cells.
4. Candidates are scored exactly inside (cell, slice) groups with one numpy
   product per group and only k per query and group leave the task; a final
   per-query top-k picks the result.

Skew: a cell may hold a large share of the corpus, or be probed by a large
share of the queries.  Each cell's vectors are cut into
``ceil(size / slice_rows)`` slices by a hash of the node id and its probing
queries likewise (the slice counts are one row per cell); every (corpus
slice, query slice) pair of a cell is one group of about ``slice_rows`` rows of
either side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.dense import Nearest, _matrix, id_type
from quarry.operators.topk import rank_by_score

SLICE_ROWS = 50_000


def _unit(col: str):
    n = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.col(col), lambda x: x.cast("double") / n)


def train_cells(corpus: DataFrame, n_cells: int = 16, seed: int = 42, vec: str = "embedding") -> DataFrame:
    """Cell centroids (cell INT, centroid ARRAY<DOUBLE>) from a distributed KMeans."""
    data = corpus.select(array_to_vector(_unit(vec)).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=20).fit(data)
    spark = corpus.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cell int, centroid array<double>")


def _nearest_cells(df: DataFrame, id_col: str, vec: str, cells: DataFrame, n: int) -> DataFrame:
    """(id, vec, cell): every row with each of its ``n`` nearest cells (cosine), the vector
    carried along; cells are broadcast (``n_cells`` rows, a parameter)."""
    cent = cells.orderBy("cell").toPandas()
    sent = df.sparkSession.sparkContext.broadcast((cent["cell"].to_numpy(np.int64), _matrix(cent["centroid"])))

    def assign(batches):
        ids, M = sent.value
        for b in batches:
            if not len(b):
                continue
            S = _matrix(b["vec"]) @ M.T
            S[np.isnan(S)] = -np.inf
            k = min(n, S.shape[1])
            idx = np.argsort(-S, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(b)), k)
            yield pd.DataFrame({"id": b["id"].to_numpy(object)[at], "vec": b["vec"].to_numpy(object)[at], "cell": ids[idx].ravel()})

    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).filter(F.col("vec").isNotNull())
    return rows.mapInPandas(assign, f"id {id_type(rows, 'id')}, vec {id_type(rows, 'vec')}, cell long")


def ivf_topk(
    queries: DataFrame,
    corpus: DataFrame,
    cells: DataFrame,
    k: int = 5,
    nprobe: int = 2,
    *,
    query_id: str = "query_id",
    node_id: str = "node_id",
    vec: str = "embedding",
    exclude_self: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Approximate cosine top-k -> (query_id, node_id, score, rank); scores are exact."""
    c = _nearest_cells(corpus, node_id, vec, cells, 1).select(F.col("id").alias("node_id"), F.col("vec").alias("nv"), "cell")
    q = _nearest_cells(queries, query_id, vec, cells, nprobe).select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), "cell")
    # Slice counts per cell for both sides (one row per cell).  A group (cell,
    # corpus slice, query slice) holds about ``slice_rows`` rows of each side,
    # however skewed the cells are.
    csz = c.groupBy("cell").agg(F.count(F.lit(1)).alias("nc"))
    qsz = q.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    sizes = csz.join(qsz, "cell", "left").select(
        "cell",
        F.greatest(F.lit(1), F.ceil(F.col("nc") / F.lit(slice_rows))).cast("int").alias("ncs"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("nq", F.lit(0)) / F.lit(slice_rows))).cast("int").alias("nqs"),
    )
    cx = (
        c.join(sizes, "cell")
        .withColumn("cslice", F.pmod(F.xxhash64("node_id"), F.col("ncs")).cast("int"))
        .withColumn("qslice", F.explode(F.sequence(F.lit(0), F.col("nqs") - 1)))
    )
    qx = (
        q.join(sizes, "cell")
        .withColumn("qslice", F.pmod(F.xxhash64("query_id"), F.col("nqs")).cast("int"))
        .withColumn("cslice", F.explode(F.sequence(F.lit(0), F.col("ncs") - 1)))
    )

    def score(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        ids = qpdf["query_id"].to_numpy(object)
        best = Nearest(ids, _matrix(qpdf["qv"]), k, exclude_self)
        best.add(np.arange(len(ids)), cpdf["node_id"].to_numpy(), _matrix(cpdf["nv"]))
        at, node, score = best.rows()
        return pd.DataFrame({"query_id": ids[at], "node_id": node, "score": score})

    keys = ["cell", "cslice", "qslice"]
    cands = (
        qx.select(*keys, "query_id", "qv").groupBy(*keys)
        .cogroup(cx.select(*keys, "node_id", "nv").groupBy(*keys))
        .applyInPandas(score, f"query_id {id_type(q, 'query_id')}, node_id {id_type(c, 'node_id')}, score double")
    )
    return rank_by_score(cands, ["query_id"], k)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per query |approx top-k  intersect  exact top-k| / k; either list is computed once."""
    hits = exact.select("query_id", "node_id").join(approx.select("query_id", "node_id", F.lit(1).alias("_hit")), ["query_id", "node_id"], "left")
    return hits.groupBy("query_id").agg((F.count("_hit") / F.lit(float(k))).alias("recall"))
