"""Registered BM25 queries (T1, B1-B7, B9) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import bm25
from quarry.plans.common import as_bigint, bench_queries, corpus, doc_texts, round6, sql_tokens

# Lucene's classic English stop set, used by the library BM25 variant.
# Fixed values, in their usual order.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]


def tokenize_counts(spark: SparkSession, sf: str):
    d = corpus(spark, sf).select("node_id", tokenize("text").alias("t"))
    out = d.select(
        "node_id",
        F.size("t").alias("n_tokens"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
    )
    return as_bigint(out, "n_tokens", "n_distinct")


def bm25_term_freq(spark: SparkSession, sf: str):
    return bm25.term_freq(corpus(spark, sf))


def bm25_doc_freq(spark: SparkSession, sf: str):
    return bm25.doc_freq(bm25.term_freq(corpus(spark, sf)))


def bm25_corpus_stats(spark: SparkSession, sf: str):
    return round6(bm25.corpus_stats(corpus(spark, sf)), "avgdl")


def bm25_idf(spark: SparkSession, sf: str):
    docs = corpus(spark, sf)
    dfreq = bm25.doc_freq(bm25.term_freq(docs))
    n_docs = float(bm25.corpus_stats(docs).first()["n_docs"])
    out = dfreq.select("term", bm25.idf_expr(F.lit(n_docs)).alias("idf"))
    return round6(out, "idf")


def bm25_scores(spark: SparkSession, sf: str):
    s = bm25.bm25_scores(bench_queries(spark, sf), corpus(spark, sf)).filter("score > 0")
    return round6(s, "score")


def bm25_topk(spark: SparkSession, sf: str, k: int = 5):
    hits = bm25.bm25_topk(bench_queries(spark, sf), corpus(spark, sf), k=k)
    return as_bigint(round6(hits, "score"), "rank")


def bm25_topk_pruned(spark: SparkSession, sf: str, k: int = 5):
    """B6 with exact MaxScore-style pruning (same rows as ``bm25_topk``)."""
    hits = bm25.bm25_topk_pruned(bench_queries(spark, sf), corpus(spark, sf), k=k)
    return as_bigint(round6(hits, "score"), "rank")


def bm25_hits_with_text(spark: SparkSession, sf: str):
    hits = bm25.bm25_topk(bench_queries(spark, sf), corpus(spark, sf), k=5)
    out = bm25.attach_nodes(hits, doc_texts(spark, sf), cols=("source", "text"))
    return as_bigint(round6(out, "score"), "rank")


def bm25_stopwords_topk(spark: SparkSession, sf: str):
    hits = bm25.bm25_topk(
        bench_queries(spark, sf), corpus(spark, sf), k=5, stopwords=STOP_WORDS, plus_one=False
    )
    return as_bigint(round6(hits, "score"), "rank")


# ---------------------------------------------------------------- oracle SQL

_DOC_TOKENS = f"SELECT doc_id AS node_id, {sql_tokens('text')} AS toks FROM documents"
_TF = f"""
  d AS ({_DOC_TOKENS}),
  p AS (SELECT node_id, unnest(toks) AS term FROM d),
  tf AS (SELECT node_id, term, count(*) AS tf FROM p GROUP BY node_id, term)"""


_BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"
_DOCS = "SELECT doc_id AS node_id, text FROM documents"


def bm25_sql(k: int | None, stop: list[str] | None = None, plus_one: bool = True,
             queries_sql: str = _BENCH_Q, docs_sql: str = _DOCS, rounded: bool = True) -> str:
    """DuckDB BM25 over ``queries_sql`` (query_id, text) and ``docs_sql`` (node_id, text)."""
    sw = ""
    qsw = ""
    if stop:
        lst = ", ".join(f"'{w}'" for w in stop)
        sw = f"[x for x in {sql_tokens('text')} if x NOT IN ({lst})]"
        qsw = f" WHERE term NOT IN ({lst})"
    toks = sw or sql_tokens("text")
    factor = "2.5::DOUBLE" if plus_one else "1.0::DOUBLE"
    scored = f"""
WITH d AS (SELECT node_id, {toks} AS toks FROM ({docs_sql})),
  st AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(toks))::DOUBLE AS avgdl FROM d),
  p AS (SELECT node_id, len(toks) AS dl, unnest(toks) AS term FROM d),
  tf AS (SELECT node_id, dl, term, count(*) AS tf FROM p GROUP BY node_id, dl, term),
  dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  q AS (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM ({queries_sql})),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM q{qsw} GROUP BY query_id, term),
  s AS (
    SELECT qt.query_id, tf.node_id,
           sum(qt.qtf * ln(1 + (st.n_docs - dfr.df + 0.5::DOUBLE) / (dfr.df + 0.5::DOUBLE))
               * (tf.tf * {factor})
               / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.dl / st.avgdl))) AS score
    FROM qt JOIN tf ON qt.term = tf.term JOIN dfr ON dfr.term = qt.term CROSS JOIN st
    GROUP BY qt.query_id, tf.node_id)"""
    if k is None:
        return scored + "\nSELECT query_id, node_id, round(score, 6) AS score FROM s WHERE score > 0"
    out_score = "round(score, 6)" if rounded else "score"
    return scored + f"""
SELECT query_id, node_id, {out_score} AS score, rank FROM (
  SELECT query_id, node_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank
  FROM s WHERE score > 0) WHERE rank <= {k}"""


_bm25_sql = bm25_sql


BM25_TOPK_SQL = _bm25_sql(5)

ORACLE = {
    "tokenize_counts": f"""
SELECT doc_id AS node_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct
FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)""",
    "bm25_term_freq": f"WITH {_TF}\nSELECT node_id, term, tf FROM tf",
    "bm25_doc_freq": f"WITH {_TF}\nSELECT term, count(*) AS df FROM tf GROUP BY term",
    "bm25_corpus_stats": f"""
SELECT count(*) AS n_docs, round(avg(len({sql_tokens('text')}))::DOUBLE, 6) AS avgdl FROM documents""",
    "bm25_idf": f"""
WITH {_TF},
  dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, round(ln(1 + (st.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfr CROSS JOIN st""",
    "bm25_scores": _bm25_sql(None),
    "bm25_topk": BM25_TOPK_SQL,
    "bm25_topk_pruned": BM25_TOPK_SQL,
    "bm25_hits_with_text": f"""
WITH h AS ({BM25_TOPK_SQL})
SELECT h.node_id, h.query_id, h.score, h.rank, d.source, d.text
FROM h JOIN documents d ON d.doc_id = h.node_id""",
    "bm25_stopwords_topk": _bm25_sql(5, STOP_WORDS, plus_one=False),
}

QUERIES = {
    "tokenize_counts": tokenize_counts,
    "bm25_term_freq": bm25_term_freq,
    "bm25_doc_freq": bm25_doc_freq,
    "bm25_corpus_stats": bm25_corpus_stats,
    "bm25_idf": bm25_idf,
    "bm25_scores": bm25_scores,
    "bm25_topk": bm25_topk,
    "bm25_topk_pruned": bm25_topk_pruned,
    "bm25_hits_with_text": bm25_hits_with_text,
    "bm25_stopwords_topk": bm25_stopwords_topk,
}
