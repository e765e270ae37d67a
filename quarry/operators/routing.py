"""Two-hop and routed retrieval.

Routing is a column: each query gets exactly one target, then every branch
runs only on the queries routed to it (filter per branch, union of results).
The target list is a small declared table; the queries
are never paired with targets as rows -- similarity is a sparse dot product
joined on term.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import identifier_like, tokenize
from quarry.operators import dense
from quarry.operators.topk import materialize, rank_by_score

# Target descriptions of the reference examples, in listed order.
ENGINE_TARGETS = [
    (1, "enterprise_rag_engine",
     "Use this engine for questions about the indexed technical RAG knowledge base, system architecture, "
     "error codes (e.g., ERR-401), vector databases, and indexing pipelines."),
    (2, "python_query_engine",
     "Use this engine specifically for questions about Python programming, Python use cases, libraries, "
     "syntax, and Python software development."),
]
RETRIEVER_TARGETS = [
    (1, "dense",
     "Use this retriever for semantic, conceptual, and broad questions where understanding meaning and "
     "context is essential."),
    (2, "keyword",
     "Use this retriever for exact keywords, error codes, technical terms, identifiers, exact names, and "
     "phrase matching."),
]
FUNCTION_TARGETS = [
    (1, "add", "Add two integers."),
    (2, "multiply", "Multiply two integers."),
]
POINTERS = [
    (1, "rag_retriever",
     "Comprehensive information about Retrieval-Augmented Generation (RAG), vector stores, and embeddings."),
    (2, "python_retriever", "Concepts, syntax, data structures, and programming patterns in Python."),
]

TARGET_SCHEMA = "target_id int, name string, description string"


def targets_df(spark: SparkSession, rows=ENGINE_TARGETS) -> DataFrame:
    """A described-target table; its text is name + newline + description."""
    return spark.createDataFrame(rows, TARGET_SCHEMA).withColumn(
        "target_text", F.concat_ws("\n", "name", "description")
    )


def _term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return (
        df.select(key, F.explode_outer(tokenize(text)).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )


def route_by_similarity(queries: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """Best-matching target per query by term-vector cosine of query
    text and target text; ties and no overlap go to the first listed target.

    Output: (query_id, target_id, name, description, sim).
    """
    qt = _term_counts(queries, "query_id", text)
    # Join strategies are left to Spark, which sees the sizes at run time.
    tt = _term_counts(targets, "target_id", "target_text")
    qn = qt.groupBy("query_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("qn"))
    tn = tt.groupBy("target_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("tn"))
    dot = (
        qt.join(tt.withColumnRenamed("tf", "ttf"), "term")
        .groupBy("query_id", "target_id")
        .agg(F.sum(F.col("tf") * F.col("ttf")).alias("dot"))
    )
    sim = dot.join(qn, "query_id").join(tn, "target_id").select(
        "query_id", "target_id", (F.col("dot") / (F.col("qn") * F.col("tn"))).alias("sim")
    )
    best = rank_by_score(sim, ["query_id"], 1, score="sim", node="target_id", rank_col="_r").drop("_r")
    first = targets.agg(F.min("target_id")).first()[0]  # declared target list
    routed = (
        queries.select("query_id")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("target_id", F.lit(first)).alias("target_id"),
            F.coalesce("sim", F.lit(0.0)).alias("sim"),
        )
    )
    return routed.join(targets.select("target_id", "name", "description"), "target_id")


def route_by_rule(queries: DataFrame, text: str = "text") -> DataFrame:
    """R4 default rule: an identifier in the query (``ERR-401``, digits) -> keyword, else dense."""
    return queries.withColumn("route", F.when(identifier_like(F.col(text)), F.lit("keyword")).otherwise(F.lit("dense")))


def route_from_decisions(queries: DataFrame, decisions: DataFrame, text: str = "text") -> DataFrame:
    """R4 with an external decisions table (query_id, route), e.g. written by
    an offline model job; queries without a decision fall back to the rule."""
    ruled = route_by_rule(queries, text).withColumnRenamed("route", "_rule")
    return ruled.join(decisions.select("query_id", F.col("route").alias("_dec")), "query_id", "left").select(
        *queries.columns, F.coalesce("_dec", "_rule").alias("route")
    )


def run_routes(
    routed: DataFrame,
    branches: Mapping[str, Callable[[DataFrame], DataFrame]],
    route_col: str = "route",
) -> DataFrame:
    """Run each branch on the queries routed to it and stack the results.

    The loop is over the declared branch names (a handful), not over data.
    """
    # every branch filters the same decisions (one row per query): compute once
    routed = materialize(routed)
    out = None
    for name, fn in branches.items():
        part = fn(routed.filter(F.col(route_col) == name)).withColumn(route_col, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def first_hop(queries: DataFrame, pointers: DataFrame) -> DataFrame:
    """R2: best pointer per query (k = 1) -> (query_id, index_id, score)."""
    hits = dense.dense_topk(queries, pointers.withColumnRenamed("index_id", "node_id"), 1)
    return hits.select("query_id", F.col("node_id").alias("index_id"), "score")


def second_hop(queries: DataFrame, hop1: DataFrame, collections: DataFrame, k: int = 2,
                 collection_col: str = "collection", exclude_self: bool = False) -> DataFrame:
    """Dereference the chosen pointer and search only that collection.

    An index id that names no collection is an error (checked by anti join).
    """
    known = collections.select(F.col(collection_col).alias("index_id")).distinct()
    unknown = hop1.select("index_id").distinct().join(known, "index_id", "left_anti")
    bad = unknown.limit(5).collect()
    if bad:
        raise KeyError(f"unknown index_id(s): {[r['index_id'] for r in bad]}")
    q = queries.join(hop1.select("query_id", "index_id"), "query_id")
    return dense.dense_topk(q, collections, k, match=("index_id", collection_col), exclude_self=exclude_self)
