"""Mixing sources to target weights: capped water-filling and seeded repetition.

Pure DataFrame work:

1. ``water_fill``: every source gets ``level * weight`` words, clamped at
   ``max_epochs`` times its size; what a clamped source cannot take is shared by
   weight among the others.  With sources ordered by cap / weight this is one
   pass: a source is clamped exactly if its cap is reached at the level the
   sources from it on would share, and the level of the first unclamped source
   is the final one.  It equals repeating "clamp, redistribute" until none is above.
2. ``fractions``: a target of 1.37 epochs is one whole repetition of every
   document and 0.37 of the source's words once more.  The words of the last
   partial repetition are found on a histogram over a seeded hash of the id, so
   nothing is sorted per document: buckets below the threshold are taken, those
   above are not, and the threshold is interpolated inside one bucket.
3. ``mix``: each document is taken ``whole`` times, and once more if its hash is
   below its source's threshold.

Only tables of one row per source (and bucket) are ever ordered.  Documents are
read once; (id, source, size, hash) is stored and joined with the small table.

Defined cases: null or empty text has size 0 and takes 0; null sources form one
source, ordered last; a null id hashes like ''; repeated rows count each; a
source of size 0 has target 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, documents, stored

HASH_BITS = 32


def seeded_hash(id_column: str, seed: str) -> Column:
    """32 bits of md5(seed:id), as a long."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, total: Column, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to a table (source, source_size, weight); ``total`` words are to be given."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, from_here = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        sources.withColumn("_cap", cap)
        .withColumn("_total", total)
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
        .withColumn("_open", F.col("_cap") > F.col("_level") * F.col("weight"))
    )
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(Window.partitionBy())
    return (
        filled.withColumn("_first_open", level["level"])
        .withColumn("target", F.when(F.col("_open"), F.least("_cap", F.col("_first_open") * F.col("weight"))).otherwise(F.col("_cap")))
        .drop("_cap", "_total", "_level", "_open", "_first_open")
    )


def fractions(sized: DataFrame, targets: DataFrame, buckets: int = 4096) -> DataFrame:
    """(source, source_size, target, whole, threshold): repetitions of every
    document, and the hash below which a document is taken once more."""
    width = (1 << HASH_BITS) // buckets
    histogram = sized.groupBy("source", F.floor(F.col("hash") / width).alias("bucket")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("target") - F.col("whole") * F.col("source_size")
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("part", part)
    inside = (F.col("part") >= F.col("below")) & (F.col("part") < F.col("below") + F.col("words"))
    threshold = F.max(F.when(inside, F.col("bucket") * width + F.floor((F.col("part") - F.col("below")) / F.col("words") * width)))
    return (
        histogram.withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .withColumnRenamed("source", "_source")
        .join(plan, F.col("_source").eqNullSafe(F.col("source")))
        .groupBy("source", "source_size", "target", "whole")
        .agg(F.coalesce(threshold, F.lit(0)).cast("long").alias("threshold"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, repetitions, taken) of every document.

    Sources in code-point order (null last) weigh ``weights``, repeating; the
    mix holds ``share`` times all words; no source passes ``max_epochs``.
    """
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), seeded_hash("doc_id", seed).alias("hash")), "mix-sizes")
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    targets = water_fill(sources, F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)), max_epochs)
    plan = fractions(sized, targets).withColumnRenamed("source", "_source")
    times = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (
        sized.join(plan, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("repetitions", times)
        .select("doc_id", "source", "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "text", "source")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS total, source_size * 2.0::DOUBLE AS cap
  FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final_level AS (SELECT min_by(level, cap / weight) AS final FROM levels WHERE cap > level * weight),
targets AS (
  SELECT source, source_size, CASE WHEN cap > level * weight THEN least(cap, (SELECT final FROM final_level) * weight) ELSE cap END AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
histogram AS (
  SELECT source, hash // 1048576 AS bucket, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
cumulated AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below
  FROM histogram),
thresholds AS (
  SELECT p.source, max(CASE WHEN target - whole * source_size >= below AND target - whole * source_size < below + words
                            THEN bucket * 1048576 + floor((target - whole * source_size - below) / words * 1048576)::BIGINT END) AS threshold
  FROM plan p JOIN cumulated c ON p.source IS NOT DISTINCT FROM c.source GROUP BY p.source)
SELECT s.doc_id, s.size, p.source_size, round(p.target, 6) AS target,
       s.size * (p.whole + CASE WHEN s.hash < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN thresholds t ON s.source IS NOT DISTINCT FROM t.source
"""

QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLE = {"op7_mix_sources": OP7_SQL}
