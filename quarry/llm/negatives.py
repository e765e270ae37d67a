"""Hard negatives by a vertical scan (branch and bound on decomposed data).

A batch of candidates is held by columns, one array per dimension with its least
and greatest value.  An anchor reads the columns in descending magnitude of its own
components.  After every few columns each candidate's score lies between its sum so
far plus the least, and plus the greatest, that the unread dimensions can still add;
candidates whose interval cannot matter leave the bitmap, until the survivors' sums
are whole and exact.

1. Positives: the best ``positives`` other rows of an anchor's label.  A candidate
   goes when its upper end is below the worst of the best found so far, or below the
   same rank among the batch's lower ends.
2. Negatives: for each positive the best ``per_positive`` rows of other labels with
   ``low * positive <= 100 * score <= high * positive`` (scores; ``low``, ``high`` in
   percent).  A candidate goes when its interval meets no window of the anchor; a
   window's lower end rises to its worst kept score once it is full.

The candidates stay where they are read.  Anchors are sent to them in slices of at
most ``slice_bytes``, by hash of the row; a task keeps a bounded number of rows per
anchor (or window) of the slice, and a ranking per anchor (or window) joins the tasks.

Scores are exact: 64-bit integers where the magnitudes leave room, Python integers
otherwise; a score beyond a long is reported, and opens windows, as the nearest long.

Defined cases: rows without an id or label, and vectors that are null, empty or hold
a null or non-finite component, take no part; a component beyond 2**62 after scaling
counts as 2**62; only vectors of the anchor's length are candidates; rows are told
apart by a row number, so rows that repeat an id or a vector each count (anchors of one
id give their rows each); ties go to the smaller id, then row; with fewer rows than
asked for all are returned; a positive with an empty window gives no row; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.sources.tables import table

SLICE_BYTES = 16 << 20
COLUMNS_AT_ONCE = 8
LARGEST = 1 << 62
LONGEST = (1 << 63) - 1


def scaled(vectors: DataFrame, id_column: str, vector: str, label: Column, factor: float = 256.0) -> DataFrame:
    """(row, vec_id, label, x), stored: the usable rows with a number of their own, components as floor(factor * component)."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def component(c: Column) -> Column:
        wide = F.lit(factor) * c.cast("double")
        return F.floor(F.least(F.greatest(wide, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")

    usable = F.col(id_column).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & ~bad
    rows = vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector, component).alias("x")
    )
    return stored(rows, "negatives-rows")  # written once, so that a row keeps its number


class Columns:
    """Rows of one length by dimension: ``x[j]`` is dimension j of all rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.labels, self.x = rows, ids, labels, np.ascontiguousarray(x.T)
        self.low, self.high = self.x.min(axis=1), self.x.max(axis=1)
        self.largest = [max(-int(a), int(b)) for a, b in zip(self.low, self.high)]

    def room(self, q: np.ndarray) -> bool:
        """Whether every partial sum of a product with ``q`` fits a 64-bit integer."""
        return sum(abs(int(a)) * b for a, b in zip(q, self.largest)) < LARGEST

    def wide(self) -> Columns:
        """The same columns as Python integers."""
        out = object.__new__(Columns)
        out.__dict__.update(self.__dict__)
        out.x, out.low, out.high = self.x.astype(object), self.low.astype(object), self.high.astype(object)
        return out


def by_length(batch) -> dict[int, Columns]:
    """Arrow rows (row, vec_id, label, x) by length of x."""
    rows, ids, labels = (batch.column(i).to_numpy() if hasattr(batch.column(i), "chunks") else batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    lists = batch.column(3)
    lists = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    offsets, values = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    return {int(n): Columns(rows[at], ids[at], labels[at], values[starts[at][:, None] + np.arange(n)]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def as_long(values: np.ndarray) -> np.ndarray:
    """64-bit integers; Python integers beyond them become the nearest whose negative is one, too."""
    return values if values.dtype == np.int64 else np.array([min(max(int(v), -LONGEST), LONGEST) for v in values], np.int64)


def vertical_scan(q: np.ndarray, data: Columns, alive: np.ndarray, keep, at_once: int = COLUMNS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """(survivors, exact scores): reads ``data`` by columns in ``q``'s descending magnitude.

    ``keep(low, high)`` gets the interval of each live candidate's score and tells who stays.
    """
    if not data.room(q):
        data, q = data.wide(), q.astype(object)
    order = np.argsort([-abs(int(c)) for c in q], kind="stable")
    products = np.stack([q[order] * data.low[order], q[order] * data.high[order]])
    # what the dimensions from a place of the order on can still add, at least and at most
    least, most = (np.append(np.cumsum(ends[::-1])[::-1], 0) for ends in (products.min(axis=0), products.max(axis=0)))
    sums = np.zeros(len(alive), data.x.dtype)
    for i in range(0, len(order), at_once):
        dims = order[i : i + at_once]
        sums = sums + q[dims] @ data.x[dims[:, None], alive]
        rest = min(i + at_once, len(order))
        stays = keep(as_long(sums + least[rest]), as_long(sums + most[rest]))
        alive, sums = alive[stays], sums[stays]
        if not len(alive):
            break
    return alive, as_long(sums)


def best(found: tuple, k: int) -> tuple:
    """The first k of (scores, ids, rows): higher scores, then smaller ids, then rows."""
    scores, ids, rows = found
    order = np.lexsort((rows, ids, -scores))[:k]
    return scores[order], ids[order], rows[order]


EMPTY = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


def merged(a: tuple, b: tuple) -> tuple:
    return tuple(np.concatenate(c) for c in zip(a, b))


def positives_of(q: np.ndarray, row: int, label: int, data: Columns, top: tuple, k: int) -> tuple:
    """``top`` (scores, ids, rows) with the rows of ``data`` merged in."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = top[0][-1] if len(top[0]) == k else None
        if len(low) > k:
            kth = np.partition(low, -k)[-k]
            least = kth if least is None else max(least, kth)
        return np.ones(len(low), bool) if least is None else high >= least

    alive, scores = vertical_scan(q, data, np.flatnonzero((data.labels == label) & (data.rows != row)), keep)
    return best(merged(top, (scores, data.ids[alive], data.rows[alive])), k)


def negatives_of(q: np.ndarray, label: int, data: Columns, windows: list[tuple[int, int]], tops: list[tuple], k: int) -> list[tuple]:
    """The ``tops`` of the score windows (lowest, highest) with the rows of ``data`` merged in."""

    def floor_of(i: int) -> int:
        return max(windows[i][0], tops[i][0][-1]) if len(tops[i][0]) == k else windows[i][0]

    ends = [(floor_of(i), high) for i, (_, high) in enumerate(windows)]

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return reduce(np.logical_or, [(high >= a) & (low <= b) for a, b in ends])

    alive, scores = vertical_scan(q, data, np.flatnonzero(data.labels != label), keep)
    out = []
    for (a, b), top in zip(ends, tops):
        inside = (scores >= a) & (scores <= b)
        out.append(best(merged(top, (scores[inside], data.ids[alive[inside]], data.rows[alive[inside]])), k))
    return out


def slices_of(anchors: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """``anchors`` cut by hash of the row so that a slice holds about ``slice_bytes``."""
    volume = anchors.agg(F.sum(F.size("x") * 8 + 24)).first()[0] or 0
    n = -(-volume // slice_bytes) or 1
    return [anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i) if n > 1 else anchors for i in range(n)]


def scan_slice(candidates: DataFrame, anchors, start, merge, rows_of, ddl: str) -> DataFrame:
    """Every task merges its batches into a state per anchor of the slice; ``rows_of`` gives the states' rows.

    ``start(anchor table)`` -> {length: {anchor index: (vector, label, row, state)}}.
    """
    sent = candidates.sparkSession.sparkContext.broadcast(anchors)  # a bounded slice

    def run(batches) -> Iterator:
        import pyarrow as pa

        mine = start(sent.value)
        for batch in batches:
            for n, data in by_length(batch).items():
                for anchor in mine.get(n, ()):
                    merge(anchor, data)
        out = [r for anchors_of_length in mine.values() for anchor in anchors_of_length for r in rows_of(anchor)]
        names = [f.split()[0] for f in ddl.split(", ")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return candidates.select("row", "vec_id", "label", "x").mapInArrow(run, ddl)


def anchor_vectors(arrow) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for n, data in by_length(arrow).items():
        out[n] = [{"row": int(data.rows[i]), "id": int(data.ids[i]), "label": int(data.labels[i]), "x": data.x[:, i].copy()} for i in range(len(data.rows))]
    return out


def find_positives(candidates: DataFrame, anchors: DataFrame, k: int = 5, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_row, place, positive_row, positive_id, positive_score) of each anchor row (row, vec_id, label, x)."""

    def start(arrow):
        mine = anchor_vectors(arrow)
        for group in mine.values():
            for anchor in group:
                anchor["top"] = EMPTY
        return mine

    def merge(anchor: dict, data: Columns) -> None:
        anchor["top"] = positives_of(anchor["x"], anchor["row"], anchor["label"], data, anchor["top"], k)

    def rows_of(anchor: dict) -> list[tuple]:
        scores, ids, rows = anchor["top"]
        return [(anchor["row"], int(r), int(i), int(s)) for s, i, r in zip(scores, ids, rows)]

    ddl = "anchor_row long, positive_row long, positive_id long, positive_score long"
    found = [stored(scan_slice(candidates, part.select("row", "vec_id", "label", "x").toArrow(), start, merge, rows_of, ddl), "positives-slice") for part in slices_of(anchors, slice_bytes)]
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    ranked = reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return stored(ranked.select("anchor_row", "place", "positive_row", "positive_id", "positive_score"), "positives")


def find_negatives(
    candidates: DataFrame, anchors: DataFrame, positives: DataFrame, low: int = 80, high: int = 100, per_positive: int = 5, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(anchor_id, anchor_row, positive_id, positive_row, positive_score, rank, negative_id, negative_row, negative_score)."""
    # the windows travel with their anchor: a bounded list of places and scores
    windows = positives.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("windows"))
    with_windows = stored(anchors.join(windows, anchors["row"] == windows["anchor_row"]).select("row", "vec_id", "label", "x", "windows"), "negatives-anchors")

    def start(arrow):
        by_row = {r: w for r, w in zip(arrow.column("row").to_pylist(), arrow.column("windows").to_pylist())}
        mine = anchor_vectors(arrow)
        for group in mine.values():
            for anchor in group:
                given = by_row[anchor["row"]]
                anchor["places"] = [w["place"] for w in given]
                # low * p <= 100 * score <= high * p, in whole scores
                anchor["windows"] = [(-(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in given]
                anchor["tops"] = [EMPTY] * len(given)
        return mine

    def merge(anchor: dict, data: Columns) -> None:
        if any(a <= b for a, b in anchor["windows"]):
            anchor["tops"] = negatives_of(anchor["x"], anchor["label"], data, anchor["windows"], anchor["tops"], per_positive)

    def rows_of(anchor: dict) -> list[tuple]:
        return [(anchor["row"], place, int(r), int(i), int(s)) for place, (scores, ids, rows) in zip(anchor["places"], anchor["tops"]) for s, i, r in zip(scores, ids, rows)]

    ddl = "anchor_row long, place long, negative_row long, negative_id long, negative_score long"
    found = [stored(scan_slice(candidates, part.toArrow(), start, merge, rows_of, ddl), "negatives-slice") for part in slices_of(with_windows, slice_bytes)]
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_positive)
    named = positives.join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    columns = ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "rank", "negative_id", "negative_row", "negative_score"]
    return ranked.join(named, ["anchor_row", "place"]).select(*columns)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, low: int = 80, high: int = 100, per_positive: int = 5, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (as ``scaled`` makes them)."""
    anchors = rows.where(is_anchor)
    found = find_positives(rows, anchors, positives, slice_bytes)
    return find_negatives(rows, anchors, found, low, high, per_positive, slice_bytes)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = mine(scaled(vectors, "vec_id", "embedding", label), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS other_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, cr) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.other_id, s.cr) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": OP13_SQL}
