"""Exact top-k by integer inner product, pruned with multi-resolution segment statistics.

Vectors are cut into s segments (coarse: few, fine: many).  With the mean m and
deviation d of each segment of length l,

    |q - x|^2  >=  sum of l * ((m_q - m_x)^2 + (d_q - d_x)^2)

and |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so the distance bound is an upper bound
of the inner product: q.x <= sum of l * (m_q m_x + d_q d_x), one dot product of
short vectors sqrt(l) * (m, d).  A candidate whose bound is below a query's
k-th best score so far is dropped; the others go to the next finer resolution,
and the survivors of the finest get their exact integer score.

The candidates stay where they are read.  The queries are sent to them in slices
of at most ``slice_bytes`` by hash of the id; a task keeps k rows per query of
the slice, and the rows of all tasks are ranked per query.

Scores are exact: 64-bit integers where the magnitudes leave room, Python integers
otherwise; a score beyond a long is reported as the nearest long.

Defined cases: rows without an id, and vectors that are null, empty or hold a
null or non-finite component, take no part; only vectors of the query's length
are candidates; a component beyond 2**62 after scaling counts as 2**62; rows are
told apart by a row number: a query leaves out its own row only, rows that repeat
an id each count, as candidates and as queries; ties go to the smaller id, then row;
fewer than k candidates give fewer rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.negatives import EMPTY, as_long, best, merged
from quarry.sources.tables import table

RESOLUTIONS = (1, 4, 16)
SLICE_BYTES = 32 << 20
LARGEST = 1 << 62


def scaled(vectors: DataFrame, id_column: str, vector: str, factor: float = 256.0) -> DataFrame:
    """(row, vec_id, x), stored: the usable vectors with a number of their own, each component as floor(factor * component)."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def component(c: Column) -> Column:
        wide = F.lit(factor) * c.cast("double")
        return F.floor(F.least(F.greatest(wide, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")

    usable = F.col(id_column).isNotNull() & (F.size(vector) > 0) & ~bad
    rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, component).alias("x"))
    return stored(rows, "topk-rows")  # written once, so that a row keeps its number


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows (sqrt(l) * mean, sqrt(l) * deviation) of each segment; their dot product bounds q.x from above."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
    deviation = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return np.hstack((mean, deviation)) * np.sqrt(np.tile(lengths, 2))


class Matrix:
    """Vectors of one length with their statistics, coarse to fine."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, resolutions: tuple[int, ...]):
        self.rows, self.ids, self.x = rows, ids, x
        wide = x.astype(float)
        self.statistics = [segment_statistics(wide, s) for s in resolutions]
        self.norms = np.sqrt((wide * wide).sum(axis=1))

    def products(self, at: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products of some rows with ``q``; every partial sum is below the norms' product."""
        if norm * float(self.norms[at].max()) < LARGEST / 2:
            return self.x[at] @ q
        return as_long(self.x[at].astype(object) @ q.astype(object))


def by_length(rows: np.ndarray, ids: np.ndarray, offsets: np.ndarray, values: np.ndarray, resolutions: tuple[int, ...]) -> dict[int, Matrix]:
    lengths = np.diff(offsets)
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = Matrix(rows[at], ids[at], values[offsets[at][:, None] + np.arange(n)], resolutions)
    return out


def arrow_vectors(batch, resolutions: tuple[int, ...]) -> dict[int, Matrix]:
    rows, ids, lists = (c.combine_chunks() if hasattr(c, "combine_chunks") else c for c in (batch.column(i) for i in range(3)))
    offsets = lists.offsets.to_numpy()
    return by_length(rows.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False), offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False), resolutions)


def scan_batch(queries: Matrix, data: Matrix, top: dict[int, tuple], k: int) -> None:
    """Merge the k best of ``data`` into ``top`` (query -> scores, ids, rows) of each query."""
    for q in range(len(queries.ids)):
        mine_so_far = top.get(q, EMPTY)
        scores = mine_so_far[0]
        alive = np.flatnonzero(data.rows != queries.rows[q])
        if len(scores) == k:
            slack = 1e-9 * queries.norms[q] * data.norms + 1e-6  # the bounds are floating-point sums
            for mine, theirs in zip(queries.statistics, data.statistics):
                alive = alive[theirs[alive] @ mine[q] + slack[alive] >= float(scores[-1])]
        if len(alive):
            exact = data.products(alive, queries.x[q], float(queries.norms[q]))
            top[q] = best(merged(mine_so_far, (exact, data.ids[alive], data.rows[alive])), k)


def search_slice(candidates: DataFrame, queries: DataFrame, k: int, resolutions: tuple[int, ...]) -> DataFrame:
    """(query_row, query_id, row, vec_id, score): k rows per query and task.  ``queries`` is a bounded slice."""
    sent = candidates.sparkSession.sparkContext.broadcast(queries.select("row", "vec_id", "x").toArrow())

    def run(batches) -> Iterator:
        import pyarrow as pa

        mine = arrow_vectors(sent.value, resolutions)
        tops: dict[int, dict] = {n: {} for n in mine}
        for batch in batches:
            for n, data in arrow_vectors(batch, resolutions).items():
                if n in mine:
                    scan_batch(mine[n], data, tops[n], k)
        for n, top in tops.items():
            for q, (scores, ids, rows) in top.items():
                mine_rows, mine_ids = (np.full(len(ids), v[q]) for v in (mine[n].rows, mine[n].ids))
                yield pa.record_batch([mine_rows, mine_ids, rows, ids, scores], names=["query_row", "query_id", "row", "vec_id", "score"])

    return candidates.select("row", "vec_id", "x").mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score long")


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, resolutions: tuple[int, ...] = RESOLUTIONS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (row, vec_id, x) as ``scaled`` makes them."""
    volume = queries.agg(F.sum(F.size("x") * 8 + 16)).first()[0] or 0
    slices = -(-volume // slice_bytes) or 1
    found = None
    for i in range(slices):
        part = queries.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == i) if slices > 1 else queries
        rows = search_slice(candidates, part, k, resolutions)
        rows = stored(rows, "topk-slice") if slices > 1 else rows  # one slice in memory at a time
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.r AS qr, c.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM p) WHERE rank <= 5
"""

QUERIES = {"op2_topk_search": op2_topk_search}
ORACLE = {"op2_topk_search": OP2_SQL}
