"""File sources: one document per text file (S1-S3), with file metadata.

``wholetext=True`` makes each file one row; the hidden ``_metadata`` column
gives name, path, size and modification time without listing files on the
driver.  Exclusion filters on the file path prune files before they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_meta(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("value").alias("text"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def read_text_dir(spark: SparkSession, path: str, exclude: Sequence[str] = (), recursive: bool = False) -> DataFrame:
    """Every text file of a directory; ``exclude`` lists file paths
    (or names) to skip.  The document id is the file name (P1)."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = _with_meta(reader.text(path, wholetext=True))
    if exclude:
        # by path, not substring: the file path equals the entry or ends with "/<entry>"
        path_col = F.regexp_replace(F.col("file_path"), "^file:(//)?", "")
        cond = F.lit(False)
        for e in exclude:
            e = e[5:] if e.startswith("file:") else e
            cond = cond | (path_col == F.lit(e)) | path_col.endswith("/" + e.lstrip("/"))
        df = df.filter(~cond)
    return df.withColumn("doc_id", F.col("file_name"))


def read_text_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """S3: an explicit list of files."""
    return _with_meta(spark.read.text(list(paths), wholetext=True)).withColumn("doc_id", F.col("file_name"))
