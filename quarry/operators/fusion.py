"""Query fan-out, ranked-list stacking, reciprocal rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import split_lines_clean, tokenize
from quarry.operators.topk import materialize, rank_by_score, top_k

# Fixed values of the reference fusion: RRF constant, rank origin 0.
RRF_K = 60
# Fixed value: the rewrite prompt (dedented), {n} variants for {query}.
REWRITE_PROMPT = (
    "Generate %d different search queries for the user's question according to the "
    "terminologies mentioned in the query.\n\nUser query:\n%s\n\n"
    "Return only the queries, one per line. No numbering, no extra text."
)


def render_prompts(queries: DataFrame, num_queries: int = 3, text: str = "text") -> DataFrame:
    """One model request per query (the reply is parsed by ``parse_variants``)."""
    return queries.withColumn("prompt", F.format_string(REWRITE_PROMPT, F.lit(num_queries), F.col(text)))


def parse_variants(replies: DataFrame, text: str = "text", id_col: str = "query_id") -> DataFrame:
    """Reply -> (query_id, variant, text): non-empty stripped lines, numbered from 1."""
    return replies.select(
        id_col, F.posexplode(split_lines_clean(text)).alias("pos", "variant_text")
    ).select(id_col, (F.col("pos") + 1).alias("variant"), F.col("variant_text").alias("text"))


def fanout(queries: DataFrame, variants: DataFrame, num_queries: int = 4, id_col: str = "query_id") -> DataFrame:
    """the original query (variant 0) plus generated variants; equal texts
    collapse onto the first; at most ``num_queries`` rows per query."""
    orig = queries.select(id_col, F.lit(0).alias("variant"), "text")
    allv = orig.unionByName(variants.select(id_col, "variant", "text"))
    first = top_k(allv, [id_col, "text"], [F.col("variant").asc()], 1, "_dup").drop("_dup")
    return top_k(first, [id_col], [F.col("variant").asc()], num_queries, "_n").drop("_n")


def stack(*lists: DataFrame) -> DataFrame:
    """bag union of ranked lists, each already keyed by its list columns."""
    out = lists[0]
    for h in lists[1:]:
        out = out.unionByName(h)
    return out


def rrf(
    hits: DataFrame,
    list_cols: Sequence[str],
    *,
    query_col: str = "query_id",
    identity: str = "node_id",
    k: int = RRF_K,
    top: int | None = 5,
) -> DataFrame:
    """reciprocal rank fusion.

    Within each ranked list (``list_cols``) the rank is re-derived from the
    score (best first, ties to the smaller id) and starts at 0; each hit adds
    ``1 / (k + rank)`` to its identity.  ``identity`` may be a content hash:
    equal content merges and is represented by its smallest node id.
    Output: (query_id, node_id, fused, rank).
    """
    ranked = rank_by_score(hits, list(list_cols), rank_col="_r").withColumn("_r", F.col("_r") - F.lit(1))
    fused = ranked.groupBy(query_col, identity).agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("_r"))).alias("fused"),
        F.min("node_id").alias("_rep"),
    )
    if identity != "node_id":
        fused = fused.drop(identity).withColumnRenamed("_rep", "node_id")
    else:
        fused = fused.drop("_rep")
    if top is None:
        return fused
    return rank_by_score(fused, [query_col], top, score="fused")


def token_overlap(query_text: Column, node_text: Column) -> Column:
    """Default pair scorer: share of distinct query tokens present in the node."""
    q = F.array_distinct(tokenize(query_text))
    n = F.array_distinct(tokenize(node_text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, n)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(
    cands: DataFrame,
    queries: DataFrame,
    nodes: DataFrame,
    top_n: int = 3,
    *,
    score_col: str = "fused",
    scorer=token_overlap,
) -> DataFrame:
    """score (query, node text) pairs of the candidates and keep the best ``top_n``.

    The candidate list is bounded (k per query) and computed first, so that it is
    sent to the texts and the node texts are not exchanged; ties keep the earlier
    (fused) order.
    """
    cands = materialize(cands)
    q = queries.select("query_id", F.col("text").alias("_qtext"))
    n = nodes.select("node_id", F.col("text").alias("_ntext"))
    scored = cands.join(q, "query_id").join(n, "node_id").withColumn(
        "rerank_score", scorer(F.col("_qtext"), F.col("_ntext"))
    )
    return rank_by_score(
        scored.drop("_qtext", "_ntext", "rank"), ["query_id"], top_n, score="rerank_score", extra_scores=(score_col,)
    )
