"""Retrievers as callables (U2): ``retrieve(queries, nodes) -> hits``.

Every retriever takes a query table and a node table and returns the
``hits`` interchange table (query_id, node_id, score, rank from 1), so they
compose: fuse several, rerank the result, evaluate it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import bm25, dense, fusion

Retriever = Callable[[DataFrame, DataFrame], DataFrame]


def metadata_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """P5: keep rows where every ``column == value`` holds (AND); a missing
    value (null) never matches.  Applied before scoring, so Catalyst pushes it
    into the scan (and prunes partitions of a partitioned collection)."""
    cond: Column = F.lit(True)
    for k, v in filters.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def bm25_retriever(k: int = 5, **kw) -> Retriever:
    """Sparse retriever: queries (query_id, text) x nodes (node_id, text)."""
    return lambda queries, nodes: bm25.bm25_topk(queries, nodes, k=k, **kw)


def dense_retriever(k: int = 5, filters: Mapping[str, object] | None = None, **kw) -> Retriever:
    """Dense retriever: queries (query_id, embedding) x nodes (node_id, embedding)."""

    def run(queries: DataFrame, nodes: DataFrame) -> DataFrame:
        n = metadata_filter(nodes, filters) if filters else nodes
        return dense.dense_topk(queries, n, k, **kw)

    return run


def fused_retriever(retrievers: Mapping[str, tuple[Retriever, DataFrame]], k: int = 5) -> Callable[[Mapping[str, DataFrame]], DataFrame]:
    """Reciprocal-rank fusion of named retrievers.

    ``retrievers`` maps a name to (retriever, node table); the returned
    callable takes, per name, the query table to feed that retriever (text
    queries for sparse, vector queries for dense) and returns fused hits
    (query_id, node_id, fused, rank).
    """

    def run(queries_by_name: Mapping[str, DataFrame]) -> DataFrame:
        lists = [
            fn(queries_by_name[name], nodes).select(
                "query_id", F.lit(name).alias("retriever"), "node_id", "score", "rank"
            )
            for name, (fn, nodes) in retrievers.items()
        ]
        return fusion.rrf(fusion.stack(*lists), ["query_id", "retriever"], top=k)

    return run


def rerank_with_model(
    cands: DataFrame,
    queries: DataFrame,
    nodes: DataFrame,
    model_factory: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]],
    top_n: int = 3,
    score_col: str = "score",
) -> DataFrame:
    """F6 with a user pair scorer (e.g. a cross-encoder).

    ``model_factory()`` runs once per task and returns a function scoring
    lists of (query text, node text) pairs; pairs arrive in Arrow batches.
    Only the candidate list (k per query) is scored.
    """
    import pandas as pd

    pairs = cands.select("query_id", "node_id", score_col).join(
        queries.select("query_id", F.col("text").alias("_qtext")), "query_id"
    ).join(nodes.select("node_id", F.col("text").alias("_ntext")), "node_id")

    def score(batches):
        model = model_factory()
        for b in batches:
            s = model(b["_qtext"].tolist(), b["_ntext"].tolist()) if len(b) else []
            yield pd.DataFrame({"query_id": b["query_id"], "node_id": b["node_id"], score_col: b[score_col],
                                "rerank_score": pd.Series(s, dtype="float64")})

    schema = pairs.select("query_id", "node_id", score_col).schema.add("rerank_score", "double")
    scored = pairs.mapInPandas(score, schema)
    from quarry.operators.topk import rank_by_score

    return rank_by_score(scored, ["query_id"], top_n, score="rerank_score", extra_scores=(score_col,))
