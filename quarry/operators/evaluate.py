"""Retrieval-quality evaluation as joins and aggregations.

Every metric is computed for all queries at once.  Relevance is decided only
for (query, hit) pairs that were retrieved -- an equi-join of the hit list
with the judged side -- which is all hit rate and MRR need; nothing pairs
every query with every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokenize

# Thresholds for the re-aimed judges (model-free); parameters, not reference values.
GROUNDED_PASS = 0.5
RELEVANT_PASS = 0.5


def hit_rate_mrr(queries: DataFrame, hits: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, hit_rate, mrr) for every query, 0.0 without a relevant hit.

    ``hits``: (query_id, node_id, rank from 1); ``judged``: (query_id,
    node_id, relevant bool) for retrieved pairs (or a qrels table with
    relevant = true).  Queries without hits survive the left join (P10).
    """
    m = hits.join(judged.select("query_id", "node_id", "relevant"), ["query_id", "node_id"], "left")
    rel = F.coalesce(F.col("relevant"), F.lit(False))
    per = m.groupBy("query_id").agg(
        F.max(F.when(rel, F.lit(1.0)).otherwise(F.lit(0.0))).alias("hit_rate"),
        F.max(F.when(rel, F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))).alias("mrr"),
    )
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id",
        F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"),
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
    )


def judge_containment(hits: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relevant = the node text contains the query passage verbatim (retrieved pairs only)."""
    q = queries.select("query_id", F.col("text").alias("_q"))
    n = nodes.select("node_id", F.col("text").alias("_n"))
    return (
        hits.select("query_id", "node_id")
        .join(q, "query_id")
        .join(n, "node_id")
        .select("query_id", "node_id", F.col("_n").contains(F.col("_q")).alias("relevant"))
    )


def judge_same_key(hits: DataFrame, query_keys: DataFrame, node_keys: DataFrame) -> DataFrame:
    """Relevant = query and node share the key (e.g. the same label)."""
    return (
        hits.select("query_id", "node_id")
        .join(query_keys.select("query_id", F.col("key").alias("_qk")), "query_id")
        .join(node_keys.select("node_id", F.col("key").alias("_nk")), "node_id")
        .select("query_id", "node_id", (F.col("_qk") == F.col("_nk")).alias("relevant"))
    )


def groundedness(answer: Column, context: Column) -> Column:
    """E3 re-aimed: share of distinct answer tokens present in the context (null for no tokens)."""
    a = F.array_distinct(tokenize(answer))
    c = F.array_distinct(tokenize(context))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a))


def term_cosine(pairs: DataFrame, keys: list[str], left: str, right: str, out: str = "relevancy_score") -> DataFrame:
    """E4 stand-in: cosine of the term-count vectors of two text columns per pair.

    Both texts of a pair are exploded once; one aggregation by (pair, term) counts a
    term on either side, a second by pair sums the products, so a hot term spreads
    over the pairs.  Null when either side has no term.
    """
    def side(text: str, a: float, b: float):
        tokens = F.coalesce(tokenize(text), F.array().cast("array<string>"))
        return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(a).alias("a"), F.lit(b).alias("b")))

    rows = pairs.select(*keys, F.explode_outer(F.concat(side(left, 1.0, 0.0), side(right, 0.0, 1.0))).alias("t"))
    counts = rows.groupBy(*keys, "t.term").agg(F.sum("t.a").alias("a"), F.sum("t.b").alias("b"))
    a, b = F.sqrt(F.sum(F.col("a") * F.col("a"))), F.sqrt(F.sum(F.col("b") * F.col("b")))
    sums = counts.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("_dot"), a.alias("_a"), b.alias("_b"))
    return sums.select(*keys, F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_dot") / (F.col("_a") * F.col("_b"))).alias(out))


def per_query(
    retrieval: DataFrame,
    faith: DataFrame | None = None,
    relev: DataFrame | None = None,
    latency: DataFrame | None = None,
    *,
    grounded_pass: float = GROUNDED_PASS,
    relevant_pass: float = RELEVANT_PASS,
) -> DataFrame:
    """One row per query with all metrics; absent values become 0.0 / false
    and latency is rounded to 3 decimals (P12)."""
    out = retrieval
    for part in (faith, relev, latency):
        if part is not None:
            out = out.join(part, "query_id", "left")
    for c in ("faithfulness_score", "relevancy_score", "latency_sec"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(
        "query_id",
        F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"),
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
        F.coalesce("faithfulness_score", F.lit(0.0)).alias("faithfulness_score"),
        F.coalesce(F.col("faithfulness_score") >= grounded_pass, F.lit(False)).alias("faithfulness_pass"),
        F.coalesce("relevancy_score", F.lit(0.0)).alias("relevancy_score"),
        F.coalesce(F.col("relevancy_score") >= relevant_pass, F.lit(False)).alias("relevancy_pass"),
        F.round(F.coalesce("latency_sec", F.lit(0.0)), 3).alias("latency_sec"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Averages over all queries; no rows in -> no row out (no division by 0)."""
    return (
        rows.agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.avg("hit_rate").alias("avg_hit_rate"),
            F.avg("mrr").alias("avg_mrr"),
            F.avg("faithfulness_score").alias("avg_faithfulness"),
            F.avg("relevancy_score").alias("avg_relevancy"),
            F.avg("latency_sec").alias("avg_latency_sec"),
        )
        .filter(F.col("n_queries") > 0)
    )
