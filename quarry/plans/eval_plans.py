"""Registered evaluation queries (E1-E8) and their DuckDB twins.

* Sparse retrieval: benchmark passages query the documents (BM25 top 5); a
  hit is relevant when the document contains the passage verbatim.
* Dense retrieval: every vector queries the others (top 5); relevant = same label.
* Judges (re-aimed, model-free): conversations -- each assistant turn is an
  answer to the user turn right before it (turn - 1).
* Per query: the answer to question i is the first assistant turn of conversation
  i, judged for groundedness in the retrieved texts and for relevancy to the
  question; its latency is the value of event i.
* Run log: events, ``value`` read as latency in seconds, per event type.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, dense, evaluate
from quarry.operators.topk import materialize
from quarry.plans.common import bench_queries, corpus, doc_texts, round6, sql_tokens, vectors
from quarry.plans.dense_plans import _topk_sql
from quarry.plans.sparse import BM25_TOPK_SQL
from quarry.sources.tables import table


def _sparse_eval(spark, sf):
    q = bench_queries(spark, sf)
    docs = corpus(spark, sf)
    # the hit list (k per query) feeds several metrics: materialise it once,
    # with the hit texts (late lookup on node_id: the hits go to the documents)
    hits = materialize(bm25.bm25_topk(q, docs, k=5))
    texts = materialize(
        hits.join(doc_texts(spark, sf), "node_id").join(q.select("query_id", F.col("text").alias("qtext")), "query_id")
    )
    judged = texts.select("query_id", "node_id", F.col("text").contains(F.col("qtext")).alias("relevant"))
    return q, texts, evaluate.hit_rate_mrr(q, texts.select("query_id", "node_id", "rank"), judged)


def eval_hit_rate(spark: SparkSession, sf: str):
    return _sparse_eval(spark, sf)[2].select("query_id", "hit_rate")


def eval_mrr(spark: SparkSession, sf: str):
    return round6(_sparse_eval(spark, sf)[2].select("query_id", "mrr"), "mrr")


def eval_dense_hit_mrr(spark: SparkSession, sf: str):
    v = vectors(spark, sf)
    q = v.select(F.col("node_id").alias("query_id"), "embedding")
    hits = dense.dense_topk(q, v, 5, exclude_self=True)
    judged = evaluate.judge_same_key(
        hits,
        v.select(F.col("node_id").alias("query_id"), F.col("label").alias("key")),
        v.select("node_id", F.col("label").alias("key")),
    )
    return round6(evaluate.hit_rate_mrr(q, hits, judged), "mrr")


def _answer_pairs(spark, sf):
    conv = table(spark, sf, "conversations")
    ans = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    usr = conv.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    # preceding turn = turn - 1: an equi-join on (conv_id, turn), so a long
    # conversation never lands whole in one task
    return ans.join(usr, ["conv_id", "turn"])


def eval_groundedness(spark: SparkSession, sf: str):
    p = _answer_pairs(spark, sf).select(
        "conv_id", "turn", evaluate.groundedness(F.col("answer"), F.col("question")).alias("faithfulness_score")
    )
    out = p.select(
        "conv_id", "turn",
        F.coalesce("faithfulness_score", F.lit(0.0)).alias("faithfulness_score"),
        F.coalesce(F.col("faithfulness_score") >= evaluate.GROUNDED_PASS, F.lit(False)).alias("faithfulness_pass"),
    )
    return round6(out, "faithfulness_score")


def eval_relevancy(spark: SparkSession, sf: str):
    r = evaluate.term_cosine(_answer_pairs(spark, sf), ["conv_id", "turn"], "question", "answer")
    out = r.select(
        "conv_id", "turn",
        F.coalesce("relevancy_score", F.lit(0.0)).alias("relevancy_score"),
        F.coalesce(F.col("relevancy_score") >= evaluate.RELEVANT_PASS, F.lit(False)).alias("relevancy_pass"),
    )
    return round6(out, "relevancy_score")


def _per_query(spark, sf):
    q, texts, retrieval = _sparse_eval(spark, sf)
    ctx = texts.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("context"))
    said = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    answers = said.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("answer"))
    faith = ctx.join(answers, "query_id").select(
        "query_id", evaluate.groundedness(F.col("answer"), F.col("context")).alias("faithfulness_score")
    )
    pairs = q.join(answers, "query_id").select("query_id", "answer", F.col("text").alias("question"))
    relev = evaluate.term_cosine(pairs, ["query_id"], "question", "answer")
    latency = table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("latency_sec"))
    return evaluate.per_query(retrieval, faith, relev, latency)


def eval_per_query(spark: SparkSession, sf: str):
    return round6(_per_query(spark, sf), "mrr", "faithfulness_score", "relevancy_score")


def eval_summary(spark: SparkSession, sf: str):
    s = evaluate.summary(_per_query(spark, sf))
    return round6(s, "avg_hit_rate", "avg_mrr", "avg_faithfulness", "avg_relevancy", "avg_latency_sec")


def eval_latency_summary(spark: SparkSession, sf: str):
    ev = table(spark, sf, "events")
    out = ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg(F.round("value", 3)).alias("avg_latency_sec"),
    )
    return round6(out, "avg_latency_sec")


# ---------------------------------------------------------------- oracle SQL

_SPARSE_EVAL = f"""
WITH h AS ({BM25_TOPK_SQL}),
  j AS (SELECT h.query_id, h.node_id, h.rank, contains(d.text, b.text) AS relevant
        FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.node_id),
  per AS (SELECT query_id, max(CASE WHEN relevant THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate,
                 max(CASE WHEN relevant THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END) AS mrr
          FROM j GROUP BY query_id),
  r AS (SELECT b.item_id AS query_id, coalesce(per.hit_rate, 0.0::DOUBLE) AS hit_rate,
               coalesce(per.mrr, 0.0::DOUBLE) AS mrr
        FROM benchmark b LEFT JOIN per ON per.query_id = b.item_id)"""


def _grounded_sql(ans: str, ctx: str) -> str:
    a = f"list_distinct({sql_tokens(ans)})"
    c = f"list_distinct({sql_tokens(ctx)})"
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {c}))::DOUBLE / len({a}) END"


def _cosine_sql(pairs: str, keys: list[str], left: str, right: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    on_p = lambda t: " AND ".join(f"{t}.{x} = p.{x}" for x in keys)
    return f"""
WITH p AS ({pairs}),
  ta AS (SELECT {k}, term, count(*)::DOUBLE AS ta FROM (SELECT {k}, unnest({sql_tokens(left)}) AS term FROM p) GROUP BY ALL),
  tb AS (SELECT {k}, term, count(*)::DOUBLE AS tb FROM (SELECT {k}, unnest({sql_tokens(right)}) AS term FROM p) GROUP BY ALL),
  na AS (SELECT {k}, sqrt(sum(ta * ta)) AS na FROM ta GROUP BY ALL),
  nb AS (SELECT {k}, sqrt(sum(tb * tb)) AS nb FROM tb GROUP BY ALL),
  dp AS (SELECT {", ".join("a." + x for x in keys)}, sum(ta * tb) AS dot FROM ta a JOIN tb b ON {on} AND a.term = b.term
         GROUP BY ALL)
SELECT {", ".join("p." + x for x in keys)},
       CASE WHEN na.na > 0 AND nb.nb > 0 THEN coalesce(dp.dot, 0.0::DOUBLE) / (na.na * nb.nb) END AS relevancy_score
FROM p LEFT JOIN dp ON {on_p('dp')} LEFT JOIN na ON {on_p('na')} LEFT JOIN nb ON {on_p('nb')}"""


_PAIRS = """
SELECT a.conv_id, a.turn, a.text AS answer, u.text AS question
FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
WHERE a.role = 'assistant' AND u.role = 'user'"""

_ANSWERS = "SELECT conv_id AS query_id, min_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id"

_PER_QUERY = f"""
{_SPARSE_EVAL},
  ctx AS (SELECT h.query_id, string_agg(d.text, ' ') AS context
          FROM h JOIN documents d ON d.doc_id = h.node_id GROUP BY h.query_id),
  answers AS ({_ANSWERS}),
  faith AS (SELECT ctx.query_id, {_grounded_sql('a.answer', 'ctx.context')} AS faithfulness_score
            FROM ctx JOIN answers a ON a.query_id = ctx.query_id),
  relev AS ({_cosine_sql(
    f"SELECT b.item_id AS query_id, b.text AS question, a.answer FROM benchmark b JOIN ({_ANSWERS}) a ON a.query_id = b.item_id",
    ["query_id"], "question", "answer")})
SELECT r.query_id, r.hit_rate, r.mrr,
       coalesce(faith.faithfulness_score, 0.0::DOUBLE) AS faithfulness_score,
       coalesce(faith.faithfulness_score >= 0.5::DOUBLE, false) AS faithfulness_pass,
       coalesce(relev.relevancy_score, 0.0::DOUBLE) AS relevancy_score,
       coalesce(relev.relevancy_score >= 0.5::DOUBLE, false) AS relevancy_pass,
       round(coalesce(ev.value, 0.0::DOUBLE), 3) AS latency_sec
FROM r LEFT JOIN faith ON faith.query_id = r.query_id LEFT JOIN relev ON relev.query_id = r.query_id
LEFT JOIN events ev ON ev.event_id = r.query_id"""

_DENSE_HITS = _topk_sql("q.vec_id <> c.vec_id")

ORACLE = {
    "eval_hit_rate": _SPARSE_EVAL + "\nSELECT query_id, hit_rate FROM r",
    "eval_mrr": _SPARSE_EVAL + "\nSELECT query_id, round(mrr, 6) AS mrr FROM r",
    "eval_dense_hit_mrr": f"""
WITH h AS ({_DENSE_HITS}),
  j AS (SELECT h.query_id, h.rank, q.label = n.label AS relevant
        FROM h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings n ON n.vec_id = h.node_id),
  per AS (SELECT query_id, max(CASE WHEN relevant THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate,
                 max(CASE WHEN relevant THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END) AS mrr
          FROM j GROUP BY query_id)
SELECT e.vec_id AS query_id, coalesce(per.hit_rate, 0.0::DOUBLE) AS hit_rate,
       round(coalesce(per.mrr, 0.0::DOUBLE), 6) AS mrr
FROM embeddings e LEFT JOIN per ON per.query_id = e.vec_id""",
    "eval_groundedness": f"""
SELECT conv_id, turn, round(coalesce(s, 0.0::DOUBLE), 6) AS faithfulness_score,
       coalesce(s >= 0.5::DOUBLE, false) AS faithfulness_pass
FROM (SELECT conv_id, turn, {_grounded_sql('answer', 'question')} AS s FROM ({_PAIRS}))""",
    "eval_relevancy": f"""
SELECT conv_id, turn, round(coalesce(relevancy_score, 0.0::DOUBLE), 6) AS relevancy_score,
       coalesce(relevancy_score >= 0.5::DOUBLE, false) AS relevancy_pass
FROM ({_cosine_sql(_PAIRS, ['conv_id', 'turn'], 'question', 'answer')})""",
    "eval_per_query": f"""
SELECT query_id, hit_rate, round(mrr, 6) AS mrr, round(faithfulness_score, 6) AS faithfulness_score,
       faithfulness_pass, round(relevancy_score, 6) AS relevancy_score, relevancy_pass, latency_sec
FROM ({_PER_QUERY})""",
    "eval_summary": f"""
SELECT count(*) AS n_queries, round(avg(hit_rate), 6) AS avg_hit_rate, round(avg(mrr), 6) AS avg_mrr,
       round(avg(faithfulness_score), 6) AS avg_faithfulness, round(avg(relevancy_score), 6) AS avg_relevancy,
       round(avg(latency_sec), 6) AS avg_latency_sec
FROM ({_PER_QUERY}) HAVING count(*) > 0""",
    "eval_latency_summary": """
SELECT event_type, count(*) AS n_runs, round(avg(round(value, 3)), 6) AS avg_latency_sec
FROM events GROUP BY event_type""",
}

QUERIES = {
    "eval_hit_rate": eval_hit_rate,
    "eval_mrr": eval_mrr,
    "eval_dense_hit_mrr": eval_dense_hit_mrr,
    "eval_groundedness": eval_groundedness,
    "eval_relevancy": eval_relevancy,
    "eval_per_query": eval_per_query,
    "eval_summary": eval_summary,
    "eval_latency_summary": eval_latency_summary,
}
