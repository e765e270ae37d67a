"""Embedding whitening: covariance by tasks, leading eigenpairs by Householder, Sturm
counts and inverse iteration, projection of every row by broadcast.

1. Fit list: the distinct integer vectors (equal ones collapse in each task before
   they are shuffled).
2. Sums per dimension, exact; then every task adds up the products of its centred
   vectors, and the entries are summed per (i, j).  Only this dims x dims matrix
   reaches the driver (8 bytes * dims**2; dims is the vectors' length).
3. Householder reflections make the matrix tridiagonal; bisection on Sturm counts
   (how many eigenvalues lie below a point) finds the leading eigenvalues; inverse
   iteration finds their vectors, those of close eigenvalues made orthogonal to each
   other on the way; the reflections turn them back.
4. Mean and components are sent to all rows of the table, which are projected where
   they are read.  The covariance of the whitened fit list is taken the same way and
   its largest distance from the identity reported.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry, or
one that leaves a long once scaled, are dropped; if lengths differ the most frequent one
is taken (of equals the longer) and other rows are dropped; repeated rows and null ids
each give their rows; components whose eigenvalue is zero to rounding cannot be
whitened and are left out, so fewer distinct vectors or dims give fewer components,
and equal vectors only, or an empty table, an empty result; a component's entry of
greatest magnitude is positive; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.sources.tables import table

#: Doubles below this are whole longs after scaling; half of the long range is left to differences.
LARGEST = float(1 << 61)
LOW_BITS = 32
EPS = np.finfo(float).eps


def scaled(vectors: DataFrame, id_column: str, vector: str, factor: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): the usable vectors, each entry as floor(factor * entry) + offset."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(F.lit(factor) * c.cast("double")) >= LARGEST))
    rows = vectors.where((F.size(vector) > 0) & ~bad)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(F.lit(factor) * c.cast("double")).cast("long") + F.lit(offset)).alias("x"))


def matrices(batches, column: str = "x") -> Iterator[tuple]:
    """(batch, matrix of its vectors), all of one length."""
    for b in batches:
        lists = b.column(b.schema.get_field_index(column))
        if len(lists):
            yield b, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def pairs_summed(df: DataFrame, dims: int, contribution) -> np.ndarray:
    """dims x dims matrix of sums: ``contribution(matrix)`` of every batch, added up per task, then per entry."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros((dims, dims))
        for _, x in matrices(batches):
            total += contribution(x)
        i, j = np.triu_indices(dims)
        yield pa.record_batch([i.astype(np.int32), j.astype(np.int32), total[i, j]], names=["i", "j", "value"])

    out = np.zeros((dims, dims))
    for i, j, value in df.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():  # dims * (dims + 1) / 2 rows
        out[i, j] = out[j, i] = value
    return out


def column_sums(df: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, exact sums per dimension) as Python integers."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in matrices(batches):
            n += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        yield pa.record_batch([np.arange(-1, dims, dtype=np.int32), np.append(n, high), np.append(0, low)], names=["j", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    got = {r.j: (int(r.high) << LOW_BITS) + int(r.low) for r in df.mapInArrow(run, "j int, high long, low long").groupBy("j").agg(*wide).collect()}  # dims + 1 rows
    return got.get(-1, 0) >> LOW_BITS, [got.get(j, 0) for j in range(dims)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n as doubles: the whole part is taken off exactly, then the fraction."""
    whole, rest = zip(*(divmod(s, n) for s in sums))
    return (x - np.array(whole, np.int64)).astype(float) - np.array([r / n for r in rest])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflection vectors) of the Householder form of symmetric ``a``."""
    a, size, reflections = a.copy(), len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale == 0.0 or not np.any(v[1:]):
            reflections.append(np.zeros_like(v))
            continue
        v /= scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        reflections.append(v)
        # H a H with H = 1 - 2 v v', on the trailing block and its border
        block = a[k + 1 :, k + 1 :]
        p = 2.0 * (block @ v)
        w = p - (p @ v) * v
        block -= np.outer(v, w) + np.outer(w, v)
        border = a[k + 1 :, k]
        border -= 2.0 * (border @ v) * v
        a[k, k + 1 :] = border
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def turned_back(z: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of the tridiagonal form as vectors of the matrix it was made from."""
    z = z.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        z[k + 1 :] -= 2.0 * np.outer(v, v @ z[k + 1 :])
    return z


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal form lie below each point."""
    tiny = max(np.finfo(float).tiny * 4, EPS * EPS * float(np.abs(off).max(initial=0.0)))
    count, pivot = np.zeros(len(points), int), np.ones(len(points))
    for i, d in enumerate(diagonal):
        pivot = d - points - ((off[i - 1] * off[i - 1]) / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection of all at once."""
    size = len(diagonal)
    radius = np.zeros(size)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    norm = float(np.max(np.abs(diagonal) + radius))
    lo, hi = np.full(k, np.min(diagonal - radius) - EPS * norm), np.full(k, np.max(diagonal + radius) + EPS * norm)
    wanted = size - 1 - np.arange(k)  # the eigenvalue with this many below it
    while True:
        mid = (lo + hi) / 2.0
        open_ = (mid > lo) & (mid < hi) & (hi - lo > EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not open_.any():
            return mid
        over = below(diagonal, off, mid) > wanted
        hi, lo = np.where(open_ & over, mid, hi), np.where(open_ & ~over, mid, lo)


def solver(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Function b -> x with (T - shift) x = b, by elimination with row exchanges; pivots are at least ``tiny``."""
    size = len(diagonal)
    u0, u1, u2 = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    factor, swapped = np.zeros(size), np.zeros(size, bool)
    for i in range(size - 1):
        below_ = off[i]
        if abs(u0[i]) >= abs(below_):
            u0[i] = u0[i] if abs(u0[i]) >= tiny else np.copysign(tiny, u0[i])
            factor[i] = below_ / u0[i]
            u0[i + 1] -= factor[i] * u1[i]
        else:
            swapped[i] = True
            factor[i] = u0[i] / below_
            old = u1[i]
            u0[i], u1[i], u2[i] = below_, u0[i + 1], u1[i + 1]
            u0[i + 1], u1[i + 1] = old - factor[i] * u1[i], -factor[i] * u2[i]
    u0[-1] = u0[-1] if abs(u0[-1]) >= tiny else np.copysign(tiny, u0[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(size - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(size - 1, -1, -1):
            rest = x[i] - (u1[i] * x[i + 1] if i + 1 < size else 0.0) - (u2[i] * x[i + 2] if i + 2 < size else 0.0)
            x[i] = rest / u0[i]
        return x

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 12, close: float = 1e-3) -> np.ndarray:
    """Unit vectors (columns) of the falling ``values``, by inverse iteration; within a cluster
    (neighbours nearer than ``close`` times the norm) each is made orthogonal to those before it."""
    size = len(diagonal)
    norm = float(np.max(np.abs(diagonal)) + 2.0 * np.max(np.abs(off), initial=0.0)) or 1.0
    out, start, rng, last = np.zeros((size, len(values))), 0, np.random.default_rng(size), None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close * norm:
            start = j
        # equal eigenvalues are told apart a little, so that their systems differ
        shift = value if last is None or j == start else min(value, last - 2.0 * EPS * norm)
        last = shift
        solve = solver(diagonal, off, shift, EPS * norm)
        x, finest = rng.normal(size=size), np.inf
        for _ in range(steps):
            x = solve(x / np.sqrt(x @ x))
            x /= np.abs(x).max()  # a solution may be as large as 1 / eps
            for _ in range(2):
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
            x /= np.sqrt(x @ x)
            image = diagonal * x
            image[:-1] += off * x[1:]
            image[1:] += off * x[:-1]
            residual = float(np.abs(image - value * x).max())
            if residual >= finest / 2.0 and finest <= 64 * EPS * norm:
                break
            finest = min(finest, residual)
        out[:, j] = x
    return out


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of symmetric ``v``, falling, each column's greatest entry positive."""
    k = min(k, len(v))
    diagonal, off, reflections = tridiagonal(v)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = turned_back(eigenvectors(diagonal, off, values), reflections)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray  # one column each
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum of (n * x - sums)**2 of each row, exact."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        y = x - np.array(whole, np.int64)
        widest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if widest * widest * x.shape[1] < 1 << 62:
            y = self.n * y - np.array(rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * y.astype(object) - np.array(rest, object)
        return (y * y).sum(axis=1).tolist()


def length_of(rows: DataFrame) -> int:
    """The most frequent length of x, of equals the longer; 0 for an empty table."""
    first = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return first.dims if first else 0


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening of (x) rows of one length, fitted on their distinct vectors; None if nothing varies."""
    dims = length_of(rows)
    if not dims:
        return None
    distinct = stored(rows.where(F.size("x") == dims).select("x").distinct(), "whitening-fit")
    n, sums = column_sums(distinct, dims)

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ c

    v = pairs_summed(distinct, dims, products) / n
    values, vectors = leading_eigenpairs(v, components)
    some = values > max(dims * EPS * float(values[0]), 0.0)
    if not some.any():
        return None
    model = Whitening(n, sums, values[some], vectors[:, some], float(np.trace(v)))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    k = int(some.sum())

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = np.hstack([sent.value.project(x), np.ones((len(x), 1))])  # the ones gather the sums
        return w.T @ w

    gathered = pairs_summed(distinct, k + 1, whitened_products) / n
    covariance = gathered[:k, :k] - np.outer(gathered[:k, k], gathered[:k, k])
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row and component."""
    ddl = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    dims = len(model.sums) if model else 0
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in ddl.split(", ")]
        model = sent.value
        for b, x in matrices(batches) if model else ():
            k, many = len(model.values), len(x)
            ids = b.column(b.schema.get_field_index("vec_id")).take(np.repeat(np.arange(many), k))
            deviation = pa.array([str(d) for d in model.deviations(x)], pa.string()).take(np.repeat(np.arange(many), k))
            explained = np.tile(model.values / model.trace, many)
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), many), np.full(many * k, model.n), deviation, model.project(x).ravel(), explained, np.full(many * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    out = rows.where(F.size("x") == dims).select("vec_id", "x").mapInArrow(run, ddl)
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long."""
    rows = scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return whiten(rows, fit(rows)).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
