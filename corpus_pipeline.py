"""Corpus pipeline: what a crawl goes through before training.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its
predecessor kept; its result is written as Parquet and read back as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.

Defined cases follow from the operators: texts that are null or hold no letter go
in the first stage; of repeated rows and near copies one stays; an empty table
stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, lang_id, mixing, ngram_join, secrets
from quarry.llm.common import stored
from quarry.sources.tables import table

#: Texts whose language is less certain than this are rejected.
LEAST_CERTAINTY = 0.5
#: Near copies: 5-word shingles, Jaccard similarity of at least 80 %.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; others, and texts without letters, go."""
    model = lang_id.train(docs.where(~lang_id.held_out()))
    kept = lang_id.predict(docs, model).where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAINTY))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, LEAST_SIMILARITY)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    marked = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows a changed text."""
    redacted = secrets.redact(docs.withColumn("_before", F.length("text")))
    length = F.length("text")
    n_chars = F.when(length.eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(length).cast(docs.schema["n_chars"].dataType)
    return redacted.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is repeated so that sources meet their target weights."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_copies", drop_near_copies),
    ("decontaminate_benchmark", decontaminate_benchmark),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]

#: The first stage applies a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
