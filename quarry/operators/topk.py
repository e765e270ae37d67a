"""Shared building blocks: per-group top-k and materialised intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import work_path

def materialize(df: DataFrame) -> DataFrame:
    """Persist ``df`` and compute it once, now.

    A persisted but not yet computed DataFrame read by several stages that
    AQE submits concurrently is computed once per reader; materialising it
    first makes every reader hit the cache.  Blocks lost with an executor
    are recomputed from lineage.
    """
    from pyspark import StorageLevel

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df



def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the lineage
    is cut, nothing stays cached, and a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_k(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[Column],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows per group, numbered from 1.

    The filter sits directly on ``row_number`` so Catalyst plans a partial
    ``WindowGroupLimit`` before the exchange: only k rows per group and map
    task are shuffled, so a hot group never lands whole in one task.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)



def rank_by_score(
    df: DataFrame,
    partition_by: Sequence[str],
    k: int | None = None,
    *,
    score: str = "score",
    node: str = "node_id",
    rank_col: str = "rank",
    extra_scores: Sequence[str] = (),
) -> DataFrame:
    """Number rows best-first per group (and keep the first ``k``).

    Order: score rounded to 9 decimals descending (then each of
    ``extra_scores`` the same way), ties to the smaller ``node``.  The
    rounded keys are computed once per row as columns: a sort on the
    ``round`` expression itself would re-evaluate it (decimal arithmetic)
    on every comparison.
    """
    keys = [score, *extra_scores]
    tmp = df
    order = []
    for i, s in enumerate(keys):
        tmp = tmp.withColumn(f"_r9_{i}", F.round(F.col(s), 9))
        order.append(F.col(f"_r9_{i}").desc())
    order.append(F.col(node).asc())
    w = Window.partitionBy(*partition_by).orderBy(*order)
    out = tmp.withColumn(rank_col, F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col(rank_col) <= k)
    return out.drop(*[f"_r9_{i}" for i in range(len(keys))])
