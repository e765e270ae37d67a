"""Hierarchical auto-merge over the chunk tree (H1-H5).

A parent replaces its retrieved children when more than ``threshold`` of its
children were retrieved; its score is the mean of the replaced children.  The
tree has a fixed depth, so the "repeat until nothing changes" loop is unrolled
into depth-1 passes of plain joins and aggregations -- no driver fixpoint.
All groups are (query, parent) groups of a bounded hit list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.topk import materialize, rank_by_score, store

# Fixed value: merge when retrieved/total children is strictly above this.
MERGE_RATIO = 0.5


def child_counts(nodes: DataFrame) -> DataFrame:
    """Total children per parent (partial aggregation before the shuffle)."""
    return nodes.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))


def merge_ratio(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """H1: per (query, parent) retrieved children, total children, ratio, mean score.

    ``hits`` needs (query_id, node_id, score, parent_id).  Only the children of
    retrieved parents are counted.
    """
    hits = materialize(hits)
    retrieved = hits.select("parent_id").distinct()
    g = (
        hits.filter(F.col("parent_id").isNotNull())
        .groupBy("query_id", "parent_id")
        .agg(F.count(F.lit(1)).alias("n_hit"), F.avg("score").alias("mean_score"))
    )
    return g.join(child_counts(nodes.select("parent_id").join(retrieved, "parent_id", "left_semi")), "parent_id").withColumn(
        "ratio", F.col("n_hit").cast("double") / F.col("n_children")
    )


def node_info(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, pn): every node with its parent's total child count."""
    if "siblings" in nodes.columns:  # known since the cut
        return nodes.select("node_id", "parent_id", F.col("siblings").alias("pn"))
    cc = child_counts(nodes).withColumnRenamed("n_children", "pn")
    return nodes.select("node_id", "parent_id").join(cc, "parent_id", "left")


def merge_once(hits: DataFrame, info: DataFrame, threshold: float = MERGE_RATIO) -> DataFrame:
    """H2: one merge pass -> (query_id, node_id, score, parent_id, pn).

    ``hits`` carries (query_id, node_id, score, parent_id, pn).  One window
    over (query, parent) counts and averages the retrieved siblings, so the
    kept rows need no anti join; the first row of a merged group becomes the
    parent, whose own parent comes from ``info`` (one lookup join).
    """
    w = Window.partitionBy("query_id", "parent_id")
    h = (
        hits.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_m", F.avg("score").over(w))
        .withColumn("_first", F.row_number().over(w.orderBy("node_id")) == 1)
        .withColumn("_merge", F.coalesce(F.col("parent_id").isNotNull() & (F.col("_n") / F.col("pn") > F.lit(threshold)), F.lit(False)))
    )
    kept = h.filter(~F.col("_merge")).select("query_id", "node_id", "score", "parent_id", "pn")
    ups = (
        h.filter(F.col("_merge") & F.col("_first"))
        .select("query_id", F.col("parent_id").alias("node_id"), F.col("_m").alias("score"))
        .join(info, "node_id")
        .select("query_id", "node_id", "score", "parent_id", "pn")
    )
    return kept.unionByName(ups)


def hit_documents(hits: DataFrame, nodes: DataFrame, null_safe: bool = False) -> DataFrame:
    """The nodes of the documents that ``hits`` names, without their texts; all nodes if
    they name no document.  ``hits`` is small and written, so the nodes are not shuffled."""
    nodes = nodes.drop("text")
    if "doc_id" in nodes.columns:
        found = store(hits.select("node_id").join(nodes.select("node_id", "doc_id"), "node_id").select(F.col("doc_id").alias("_doc")).distinct(), "merge-docs")
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) if null_safe else F.col("doc_id") == F.col("_doc")
        nodes = nodes.join(found, same, "left_semi")
    return store(nodes, "merge-nodes")


def with_parents(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    hits = materialize(hits)  # k rows per query: known to be small, so the nodes are not shuffled
    return hits.select("query_id", "node_id", "score").join(nodes.select("node_id", "parent_id"), "node_id")


def automerge(
    hits: DataFrame, nodes: DataFrame, depth: int = 3, threshold: float = MERGE_RATIO, fill: bool = False
) -> DataFrame:
    """H3: all merge passes of a ``depth``-tier tree, then best-first ranks.

    With ``fill`` each pass first inserts one-node gaps (H4) and then merges,
    the order the library retriever uses; the default merges only.
    Output: (query_id, node_id, score, rank).
    """
    # The hit list is bounded (k per query); it is written once so the
    # retrieval behind it is not re-run by each reader.
    hits = store(hits.select("query_id", "node_id", "score"), "merge-hits")
    # merging stays inside documents: look up only the nodes of the hits' documents
    nodes = hit_documents(hits, nodes)
    info = node_info(nodes)
    cur = hits.join(info, "node_id")
    for _ in range(depth - 1):
        if fill:
            # a few rows per query; kept, as each pass reads its input several times
            ranked = store(rank_by_score(cur, ["query_id"]), "merge-ranked")
            cur = store(fill_gaps(ranked, nodes).select("query_id", "node_id", "score").join(info, "node_id"), "merge-filled")
        cur = merge_once(cur, info, threshold)
    return rank_by_score(cur.drop("parent_id", "pn"), ["query_id"])


def fill_gaps(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """H4: where list neighbours i, i+1 are siblings-but-one (same document and
    tier, sequence numbers two apart), insert the node between them with their
    mean score.  ``hits`` needs (query_id, node_id, score, rank).
    """
    pos = nodes.select("node_id", "doc_id", "level", "seq")
    # a few rows per query, read several times; written, so that they go to the nodes and not the nodes to them
    b = store(materialize(hits.select("query_id", "node_id", "score", "rank")).join(pos, "node_id"), "gap-hits")
    pos = pos.join(store(b.select("doc_id").distinct(), "gap-docs"), "doc_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    nx = b.select(
        "query_id", "doc_id", "level", "seq", "score",
        F.lead("doc_id").over(w).alias("ndoc"),
        F.lead("level").over(w).alias("nlevel"),
        F.lead("seq").over(w).alias("nseq"),
        F.lead("score").over(w).alias("nscore"),
    ).filter((F.col("ndoc") == F.col("doc_id")) & (F.col("nlevel") == F.col("level")) & (F.col("nseq") == F.col("seq") + 2))
    ins = nx.select(
        "query_id", "doc_id", "level", (F.col("seq") + 1).alias("seq"),
        ((F.col("score") + F.col("nscore")) / F.lit(2.0)).alias("score"),
    ).join(pos, ["doc_id", "level", "seq"]).select("query_id", "node_id", "score")
    ins = ins.join(b.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    out = b.select("query_id", "node_id", "score").unionByName(ins)
    return rank_by_score(out, ["query_id"])


def diff_lists(base: DataFrame, merged: DataFrame) -> DataFrame:
    """H5: compare two result lists -> (query_id, node_id, base_score, merged_score, status)."""
    a = base.select("query_id", "node_id", F.col("score").alias("base_score"))
    m = merged.select("query_id", "node_id", F.col("score").alias("merged_score"))
    return a.join(m, ["query_id", "node_id"], "full_outer").withColumn(
        "status",
        F.when(F.col("base_score").isNotNull() & F.col("merged_score").isNotNull(), F.lit("kept"))
        .when(F.col("base_score").isNotNull(), F.lit("merged_away"))
        .otherwise(F.lit("added")),
    )
