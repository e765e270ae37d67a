"""Registered chunking and auto-merge queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, chunking, dense, hierarchy
from quarry.operators.topk import materialize
from quarry.plans.common import as_bigint, bench_queries, dense_sql, round6, sql_tokens, text_vectors, text_vectors_sql
from quarry.plans.sparse import bm25_sql
from quarry.sources.tables import table

LEAF_K = 6  # fixed value: base retriever of the auto-merge example


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def chunk_fixed(spark: SparkSession, sf: str):
    return as_bigint(chunking.chunk_fixed(_docs(spark, sf), *chunking.INGEST_CHUNK), "chunk_no", "n_tokens")


def chunk_fixed_1024(spark: SparkSession, sf: str):
    return as_bigint(chunking.chunk_fixed(_docs(spark, sf), *chunking.DEFAULT_CHUNK), "chunk_no", "n_tokens")


def _tree(spark, sf, texts=True):
    return chunking.chunk_tree(_docs(spark, sf), texts=texts)


def hier_nodes(spark: SparkSession, sf: str):
    return as_bigint(_tree(spark, sf).drop("is_leaf", "siblings"), "level", "seq", "n_tokens")


def hier_leaf_root_counts(spark: SparkSession, sf: str):
    nodes = _tree(spark, sf)
    tot = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))
    leaves = chunking.leaf_nodes(nodes).groupBy("level").agg(F.count(F.lit(1)).alias("n_leaves"))
    roots = chunking.root_nodes(nodes).groupBy("level").agg(F.count(F.lit(1)).alias("n_roots"))
    out = tot.join(leaves, "level", "left").join(roots, "level", "left").fillna(0, ["n_leaves", "n_roots"])
    return as_bigint(out, "level", "n_nodes", "n_leaves", "n_roots")


def _leaf_hits(spark, sf):
    """V5: BM25 restricted to leaf nodes, top 6 per query."""
    leaves = chunking.leaf_nodes(_tree(spark, sf)).select("node_id", "text")
    return bm25.bm25_topk(bench_queries(spark, sf), leaves, k=LEAF_K)


def dense_leaf_topk(spark: SparkSession, sf: str):
    """V5: dense search among the leaf nodes only."""
    leaves = chunking.leaf_nodes(_tree(spark, sf)).select("node_id", "text")
    hits = dense.dense_topk(text_vectors(bench_queries(spark, sf), "query_id"), text_vectors(leaves), LEAF_K)
    return as_bigint(round6(hits, "score"), "rank")


def automerge_filled(spark: SparkSession, sf: str):
    """H3 and H4 as the library runs them: each pass fills gaps, then merges."""
    nodes = _tree(spark, sf, texts=False)  # merging reads no texts
    out = hierarchy.automerge(_leaf_hits(spark, sf), nodes, fill=True)
    return as_bigint(round6(out, "score"), "rank")


def automerge_ratio(spark: SparkSession, sf: str):
    nodes = _tree(spark, sf, texts=False)  # merging reads no texts
    hits = hierarchy.with_parents(_leaf_hits(spark, sf), nodes)
    out = hierarchy.merge_ratio(hits, nodes)
    return as_bigint(round6(out, "mean_score", "ratio"), "n_hit", "n_children")


def automerge_once(spark: SparkSession, sf: str):
    nodes = _tree(spark, sf, texts=False)  # merging reads no texts
    hits = materialize(_leaf_hits(spark, sf).select("query_id", "node_id", "score"))
    info = hierarchy.node_info(hierarchy.hit_documents(hits, nodes, null_safe=True))
    hits = hits.join(info, "node_id")
    return round6(hierarchy.merge_once(hits, info).drop("pn"), "score")


def automerge_full(spark: SparkSession, sf: str):
    nodes = _tree(spark, sf, texts=False)  # merging reads no texts
    out = hierarchy.automerge(_leaf_hits(spark, sf), nodes)
    return as_bigint(round6(out, "score"), "rank")


def automerge_fill_gap(spark: SparkSession, sf: str):
    nodes = _tree(spark, sf, texts=False)  # merging reads no texts
    out = hierarchy.fill_gaps(_leaf_hits(spark, sf), nodes)
    return as_bigint(round6(out, "score"), "rank")


def automerge_diff(spark: SparkSession, sf: str):
    nodes = _tree(spark, sf, texts=False)  # merging reads no texts
    base = materialize(_leaf_hits(spark, sf))
    out = hierarchy.diff_lists(base, hierarchy.automerge(base, nodes))
    return round6(out, "base_score", "merged_score")


# ---------------------------------------------------------------- oracle SQL

_SIZES = chunking.TREE_SIZES


def fixed_chunks_sql(size: int, overlap: int, src: str = "SELECT doc_id, text FROM documents") -> str:
    stride = size - overlap
    return f"""
SELECT concat_ws('/', doc_id, chunk_no) AS node_id, doc_id, chunk_no, text,
       len(string_split(text, ' '))::BIGINT AS n_tokens FROM (
  SELECT doc_id, c AS chunk_no,
         array_to_string(list_slice(toks, c * {stride} + 1, c * {stride} + {size}), ' ') AS text
  FROM (SELECT doc_id, toks, unnest(generate_series(0, nchunks - 1)) AS c FROM (
          SELECT doc_id, toks,
                 CASE WHEN len(toks) = 0 THEN 0
                      ELSE 1 + greatest(0, ceil((len(toks) - {size}) / {stride}))::BIGINT END AS nchunks
          FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM ({src}))) WHERE nchunks > 0))"""


def _path(level: int, upto: int) -> str:
    parts = ["doc_id::VARCHAR"] + [f"(seq * {_SIZES[level]} // {_SIZES[j]})::VARCHAR" for j in range(upto + 1)]
    return "concat_ws('/', " + ", ".join(parts) + ")"


TREE_SQL = "\nUNION ALL\n".join(
    f"""SELECT {_path(lvl, lvl)} AS node_id, {(_path(lvl, lvl - 1) if lvl else 'NULL::VARCHAR')} AS parent_id,
       doc_id, {lvl}::BIGINT AS level, seq::BIGINT AS seq,
       array_to_string(list_slice(toks, seq * {size} + 1, (seq + 1) * {size}), ' ') AS text
FROM (SELECT doc_id, toks, unnest(generate_series(0, ceil(len(toks) / {size})::BIGINT - 1)) AS seq
      FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents) WHERE len(toks) > 0)"""
    for lvl, size in enumerate(_SIZES)
)
TREE_FULL_SQL = f"SELECT *, len(string_split(text, ' '))::BIGINT AS n_tokens FROM ({TREE_SQL})"
_LEAF_HITS = bm25_sql(
    LEAF_K, docs_sql=f"SELECT node_id, text FROM ({TREE_SQL}) WHERE level = {len(_SIZES) - 1}", rounded=False
)
_CTE = f"""
WITH tree AS ({TREE_SQL}),
  cc AS (SELECT parent_id, count(*) AS n_children FROM tree WHERE parent_id IS NOT NULL GROUP BY parent_id),
  base AS ({_LEAF_HITS}),
  h0 AS (SELECT b.query_id, b.node_id, b.score, t.parent_id FROM base b JOIN tree t ON t.node_id = b.node_id)"""


def _pass(src: str, dst: str) -> str:
    return f""",
  g_{dst} AS (SELECT query_id, parent_id, count(*) AS n_hit, avg(score) AS mean_score FROM {src}
             WHERE parent_id IS NOT NULL GROUP BY query_id, parent_id),
  m_{dst} AS (SELECT g.* FROM g_{dst} g JOIN cc ON cc.parent_id = g.parent_id
             WHERE g.n_hit::DOUBLE / cc.n_children > 0.5::DOUBLE),
  {dst} AS (SELECT h.query_id, h.node_id, h.score, h.parent_id FROM {src} h
           WHERE NOT EXISTS (SELECT 1 FROM m_{dst} m WHERE m.query_id = h.query_id AND m.parent_id = h.parent_id)
           UNION ALL
           SELECT m.query_id, m.parent_id AS node_id, m.mean_score AS score, t.parent_id
           FROM m_{dst} m JOIN tree t ON t.node_id = m.parent_id)"""


def _fill(src: str, dst: str) -> str:
    return f""",
  r_{dst} AS (SELECT s.query_id, s.node_id, s.score, t.doc_id, t.level, t.seq,
                     row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.node_id) AS rank
              FROM {src} s JOIN tree t ON t.node_id = s.node_id),
  n_{dst} AS (SELECT *, lead(doc_id) OVER w AS ndoc, lead(level) OVER w AS nlevel, lead(seq) OVER w AS nseq,
                     lead(score) OVER w AS nscore
              FROM r_{dst} WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
  i_{dst} AS (SELECT n.query_id, t.node_id, (n.score + n.nscore) / 2.0::DOUBLE AS score
              FROM n_{dst} n JOIN tree t ON t.doc_id = n.doc_id AND t.level = n.level AND t.seq = n.seq + 1
              WHERE n.ndoc = n.doc_id AND n.nlevel = n.level AND n.nseq = n.seq + 2),
  {dst} AS (SELECT u.query_id, u.node_id, u.score, t.parent_id FROM (
              SELECT query_id, node_id, score FROM {src}
              UNION ALL
              SELECT i.query_id, i.node_id, i.score FROM i_{dst} i
              WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE b.query_id = i.query_id AND b.node_id = i.node_id)) u
            JOIN tree t ON t.node_id = u.node_id)"""


_FULL = _CTE + _pass("h0", "h1") + _pass("h1", "h2")
_FULL_RANKED = _FULL + """
SELECT query_id, node_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM h2"""

ORACLE = {
    "chunk_fixed": fixed_chunks_sql(*chunking.INGEST_CHUNK),
    "chunk_fixed_1024": fixed_chunks_sql(*chunking.DEFAULT_CHUNK),
    "hier_nodes": TREE_FULL_SQL,
    "hier_leaf_root_counts": f"""
WITH tree AS ({TREE_SQL})
SELECT level, count(*) AS n_nodes,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.node_id)) AS n_leaves,
       count(*) FILTER (WHERE parent_id IS NULL) AS n_roots
FROM tree t GROUP BY level""",
    "automerge_ratio": _CTE + """
SELECT g.parent_id, g.query_id, g.n_hit, cc.n_children, round(g.mean_score, 6) AS mean_score,
       round(g.n_hit::DOUBLE / cc.n_children, 6) AS ratio
FROM (SELECT query_id, parent_id, count(*) AS n_hit, avg(score) AS mean_score FROM h0
      WHERE parent_id IS NOT NULL GROUP BY query_id, parent_id) g JOIN cc ON cc.parent_id = g.parent_id""",
    "automerge_once": _CTE + _pass("h0", "h1") + "\nSELECT query_id, node_id, round(score, 6) AS score, parent_id FROM h1",
    "automerge_full": f"SELECT query_id, node_id, round(score, 6) AS score, rank FROM ({_FULL_RANKED})",
    "automerge_filled": _CTE + _fill("h0", "f0") + _pass("f0", "h1") + _fill("h1", "f1") + _pass("f1", "h2") + """
SELECT query_id, node_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM h2""",
    "dense_leaf_topk": f"""
SELECT query_id, node_id, round(score, 6) AS score, rank FROM ({dense_sql(
    text_vectors_sql("SELECT item_id AS query_id, text FROM benchmark", "query_id"),
    text_vectors_sql(f"SELECT node_id, text FROM ({TREE_SQL}) WHERE level = {len(_SIZES) - 1}", "node_id"), LEAF_K)})""",
    "automerge_fill_gap": _CTE + """,
  b AS (SELECT x.query_id, x.node_id, x.score, x.rank, t.doc_id, t.level, t.seq
        FROM base x JOIN tree t ON t.node_id = x.node_id),
  nx AS (SELECT *, lead(doc_id) OVER w AS ndoc, lead(level) OVER w AS nlevel, lead(seq) OVER w AS nseq,
                lead(score) OVER w AS nscore
         FROM b WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
  ins AS (SELECT nx.query_id, t.node_id, (nx.score + nx.nscore) / 2.0::DOUBLE AS score
          FROM nx JOIN tree t ON t.doc_id = nx.doc_id AND t.level = nx.level AND t.seq = nx.seq + 1
          WHERE nx.ndoc = nx.doc_id AND nx.nlevel = nx.level AND nx.nseq = nx.seq + 2),
  u AS (SELECT query_id, node_id, score FROM b
        UNION ALL
        SELECT i.query_id, i.node_id, i.score FROM ins i
        WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = i.query_id AND b.node_id = i.node_id))
SELECT query_id, node_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM u""",
    "automerge_diff": _FULL + """
SELECT coalesce(b.query_id, m.query_id) AS query_id, coalesce(b.node_id, m.node_id) AS node_id,
       round(b.score, 6) AS base_score, round(m.score, 6) AS merged_score,
       CASE WHEN b.score IS NOT NULL AND m.score IS NOT NULL THEN 'kept'
            WHEN b.score IS NOT NULL THEN 'merged_away' ELSE 'added' END AS status
FROM base b FULL OUTER JOIN h2 m ON b.query_id = m.query_id AND b.node_id = m.node_id""",
}

QUERIES = {
    "chunk_fixed": chunk_fixed,
    "chunk_fixed_1024": chunk_fixed_1024,
    "hier_nodes": hier_nodes,
    "hier_leaf_root_counts": hier_leaf_root_counts,
    "automerge_ratio": automerge_ratio,
    "automerge_once": automerge_once,
    "automerge_full": automerge_full,
    "automerge_filled": automerge_filled,
    "dense_leaf_topk": dense_leaf_topk,
    "automerge_fill_gap": automerge_fill_gap,
    "automerge_diff": automerge_diff,
}
