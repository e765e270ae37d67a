"""The collection source: round trip, all-or-nothing writes, files chosen by the key."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.collection import newest, read_collection, write_collection

ROWS = [(1, "a", "rag", 1.5), (2, None, "python", None), (3, "", None, 2.0), (4, "d", "rag", -1.0), (5, "e", "it's", 0.0)]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "c")


def nodes(spark, rows=ROWS):
    return spark.createDataFrame(rows, "node_id long, text string, category string, score double").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_append_and_overwrite(spark, path):
    write_collection(nodes(spark), path)
    assert rows(read_collection(spark, path)) == ROWS and read_collection(spark, path).schema == nodes(spark).schema
    more = [(6, "f", "rag", 3.0)]
    planned = read_collection(spark, path)
    assert planned.count() == 5
    write_collection(nodes(spark, more), path, "append")
    assert rows(read_collection(spark, path)) == ROWS + more
    write_collection(nodes(spark, more), path)
    assert rows(read_collection(spark, path)) == more
    write_collection(nodes(spark).limit(0), path)
    assert rows(read_collection(spark, path)) == [] and read_collection(spark, path).schema == nodes(spark).schema


def test_a_failed_write_leaves_the_old_rows(spark, path):
    write_collection(nodes(spark), path)
    bad = nodes(spark).withColumn("text", F.when(F.col("node_id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            write_collection(bad, path, mode)
        assert rows(read_collection(spark, path)) == ROWS and newest(path)[0] == 1
    with pytest.raises(Exception, match="schema"):
        write_collection(nodes(spark).drop("score"), path, "append")
    with pytest.raises(Exception, match="no column"):
        write_collection(nodes(spark).drop("category"), path)
    assert rows(read_collection(spark, path)) == ROWS


@pytest.mark.parametrize("pushed", ["true", "false"])
@pytest.mark.parametrize("where", ["category = 'rag'", "category IN ('python', 'it\\'s')", "category IS NULL", "category = 'rag' AND node_id > 1", "category <> 'rag'", "category <=> null", "category = 'none'"])
def test_conditions_give_the_same_rows_pushed_or_not(spark, path, where, pushed):
    write_collection(nodes(spark), path)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        assert rows(read_collection(spark, path).where(where)) == rows(nodes(spark).where(where))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_a_pushed_condition_opens_only_its_files(spark, path):
    write_collection(nodes(spark), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = read_collection(spark, path).where("category = 'python'")
        assert rows(one) == [ROWS[1]] and one.rdd.getNumPartitions() == 1
        assert read_collection(spark, path).rdd.getNumPartitions() == len(newest(path)[1]["files"]) > 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_missing_collection(spark, path):
    with pytest.raises(Exception, match="no collection"):
        read_collection(spark, path)
