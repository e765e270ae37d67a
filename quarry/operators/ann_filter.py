"""Metadata filters inside the approximate index (P5 with V4/V5).

``tag`` numbers the rows of each cell in pages of at most 32,768 and stores, per page,
column and value, a bitmap of the rows that have the value.  ``filtered`` ANDs the
bitmaps of the asked values and gives an ``Index`` of the matching rows alone: a cell
without a match is not in it and takes no probe, so a selective filter spends its
probes on cells that can answer.  ``choose_depth``, ``search`` and ``measured`` of
``ann_index`` take that index as any other; its depth is chosen from the recall that
is measured under the filter.

All of it is bitmap functions and joins.  A page is as large for a hot cell as for any
other.  Columns hold discrete values (text, whole numbers, booleans, dates).  As in
``metadata_filter``, conditions are ANDed and a null matches nothing.  ``node_id`` is
unique in the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ann_index import Index
from quarry.operators.topk import store

PAGE = 32_768  # bits of one of Spark's bitmaps
PART_ROWS = 8 * PAGE  # rows numbered by one task


@dataclass
class Tags:
    """``codes`` (node_id, cell, page, bit, code) and ``bitmaps`` (cell, page, name, value, bits)."""

    codes: DataFrame
    bitmaps: DataFrame
    types: dict[str, str]


def tag(index: Index, corpus: DataFrame, columns: Sequence[str], *, node_id: str = "node_id", part_rows: int = PART_ROWS, page: int = PAGE) -> Tags:
    """The bitmaps of ``columns`` of ``corpus`` over the rows of ``index``."""
    types = {c: corpus.schema[c].dataType.simpleString() for c in columns}
    if bad := [c for c, t in types.items() if t in ("float", "double") or t.startswith(("array", "map", "struct"))]:
        raise ValueError(f"not discrete: {bad}")
    parts = index.codes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).alias("parts"))
    within = Window.partitionBy("cell", "part").orderBy("node_id")
    numbered = (
        index.codes.join(parts, "cell")
        .withColumn("part", F.pmod(F.xxhash64("node_id"), F.col("parts")))
        .withColumn("at", F.row_number().over(within) - 1)
        .withColumn("page", F.shiftleft("part", 32) + F.floor(F.col("at") / F.lit(page)))
    )
    codes = store(numbered.select("node_id", "cell", "page", (F.col("at") % page).alias("bit"), "code"), "ann-pages")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    meta = corpus.select(F.col(node_id).alias("node_id"), F.explode(pairs).alias("p")).select("node_id", "p.*").where(F.col("value").isNotNull())
    rows = codes.select("node_id", "cell", "page", "bit").join(meta, "node_id")
    bitmaps = rows.groupBy("cell", "page", "name", "value").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    return Tags(codes, store(bitmaps, "ann-bitmaps"), types)


def has_bit(bits: str, bit: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1


def chosen(tags: Tags, filters: Mapping[str, object]) -> DataFrame:
    """(cell, page, bits): the rows that meet all of ``filters``; pages without one are absent."""
    if unknown := sorted(set(filters) - set(tags.types)):
        raise KeyError(f"no bitmaps of {unknown}")
    asked = F.lit(False)
    for name, value in filters.items():
        as_column = F.lit(value).cast(tags.types[name])
        asked = asked | ((F.col("name") == name) & (F.col("value") == as_column.cast("string")) & (as_column == F.lit(value)))
    met = tags.bitmaps.where(asked).groupBy("cell", "page").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.where((F.col("n") == len(filters)) & (F.bitmap_count("bits") > 0)).select("cell", "page", "bits")


def filtered(index: Index, tags: Tags, filters: Mapping[str, object]) -> Index:
    """The index of the rows that meet all of ``filters``."""
    if not filters:
        return index
    kept = tags.codes.join(chosen(tags, filters), ["cell", "page"]).where(has_bit("bits", "bit"))
    codes = store(kept.select("node_id", "cell", "code"), "ann-filtered")
    sizes = {r.cell: r["count"] for r in codes.groupBy("cell").count().collect()}  # a row per cell
    return Index(index.codebook, codes, index.vectors.join(codes.select("node_id"), "node_id", "left_semi"), sizes)
