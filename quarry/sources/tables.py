"""Table sources: the driver's Parquet tables and SQL views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> list[str]:
    """Expose every table as a temp view so ``spark.sql`` can query it."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return list(names)
