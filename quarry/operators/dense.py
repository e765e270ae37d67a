"""Dense retrieval: cosine similarity and exact top-k nearest nodes (V2, V3, V5).

Exact top-k never materialises (query, node) pairs as rows, and the corpus is
never shuffled.  The queries go to the corpus in slices of a fixed number of
bytes, by hash of their id; every task scores its vectors against the slice in
numpy products (``Nearest``: float32 first, float64 for what may be a hit) and
carries a running top k over its batches, so it emits k rows per query.  A per-query ``row_number <= k`` (partial ``WindowGroupLimit`` before
the exchange) picks the final list.  One strategy serves all sizes: more queries
mean more slices.

Ids keep their types: long ids, chunk ids (``"12/3"``) and names all work.

Exact all-pairs cost is O(|Q| * |C| * d) by definition; for unbounded query
sets use the IVF operator in ``quarry.operators.ann``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.topk import rank_by_score

# Bytes of query vectors (float64) that one slice brings to every task.
SLICE_BYTES = 64 * 1024 * 1024
# Upper bound on score-matrix cells held at once inside a task, and the nodes of one tile of them.
MAX_CELLS = 4_000_000
TILE_NODES = 4096
# Pairs scored one by one at once, and pairs held before the k best are taken.
PAIRS = 100_000
MAX_FOUND = 1_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product of two array columns, in double."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """V2: cosine similarity of two array columns (null for a zero vector)."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    m = np.asarray(np.stack([np.asarray(v, dtype=np.float64) for v in series]), dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, m / n, np.nan)


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class Nearest:
    """The k best nodes per query among those a task was given: score rounded to 9 decimals
    descending, then the smaller node.

    Products are taken in float32, a tile of nodes and queries at a time.  Only pairs that may
    reach their query's k-th score so far (the margin covers the float32 error) are scored in
    float64 and sorted, which are few once the first tile has set that score.
    """

    def __init__(self, qids: np.ndarray, Q: np.ndarray, k: int, exclude_self: bool):
        self.Q, self.k = Q, k
        self.Q32 = Q.astype(np.float32)
        self.usable = ~np.isnan(Q).any(axis=1)
        # a product of unit vectors is off by (d + 2) * 2^-24 at most; scores that tie once rounded to 9 decimals count too
        self.margin = 2 * (Q.shape[1] + 8) * 2.0**-24 + 2e-9
        self.scores = np.full((len(qids), k), -np.inf)
        self.nodes: np.ndarray | None = None
        self.kth = np.full(len(qids), -np.inf)
        self.code: dict = {}  # the query ids, numbered, if a query's own node is no hit
        if exclude_self:
            self.own = np.array([self.code.setdefault(x, len(self.code)) for x in qids.tolist()], np.int64)

    def add(self, rows: np.ndarray, nids: np.ndarray, C: np.ndarray) -> None:
        """Offer the nodes ``nids`` with unit vectors ``C`` to the queries ``rows``."""
        rows = rows[self.usable[rows]]
        if not len(nids) or not len(rows):
            return
        seen = ~np.isnan(C).any(axis=1)
        nids, C = nids[seen], C[seen]
        if self.nodes is None:
            self.nodes = np.empty(self.scores.shape, nids.dtype)
        elif self.nodes.dtype != nids.dtype:
            self.nodes, nids = self.nodes.astype(object), nids.astype(object)
        own = np.array([self.code.get(x, -1) for x in nids.tolist()], np.int64) if self.code else None
        C32 = C.astype(np.float32)
        for lo in range(0, len(nids), TILE_NODES):
            tile = slice(lo, lo + TILE_NODES)
            found, n = [], 0
            step = max(1, MAX_CELLS // len(nids[tile]))
            for i in range(0, len(rows), step):
                found.append(self._reaching(rows[i : i + step], C[tile], C32[tile], None if own is None else own[tile]))
                n += len(found[-1][0])
                if n > MAX_FOUND or i + step >= len(rows):
                    q, c, score = (np.concatenate(x) for x in zip(*found))
                    self._merge(q, nids[lo + c], score)
                    found, n = [], 0

    def _reaching(self, part: np.ndarray, C: np.ndarray, C32: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(query, node, score) of the pairs of a tile that may be among the k best of their query."""
        S = self.Q32[part] @ C32.T
        floor = self.kth[part]
        fresh = np.flatnonzero(np.isneginf(floor))
        if len(fresh):
            first = S[fresh]
            if own is not None:
                first[self.own[part[fresh]][:, None] == own[None, :]] = -np.inf
            at = first.shape[1] - min(self.k, first.shape[1])
            floor[fresh] = np.partition(first, at, axis=1)[:, at]
        r, c = np.divmod(np.flatnonzero(S >= (floor - self.margin).astype(np.float32)[:, None]), S.shape[1])
        if own is not None:
            other = self.own[part[r]] != own[c]
            r, c = r[other], c[other]
        if len(r) * 8 > S.size:  # ties in plenty: cheaper whole than pair by pair
            score = (self.Q[part] @ C.T)[r, c]
        else:
            score = np.empty(len(r))
            for i in range(0, len(r), PAIRS):
                j = slice(i, i + PAIRS)
                score[j] = np.einsum("ij,ij->i", self.Q[part[r[j]]], C[c[j]])
        reach = score >= self.kth[part[r]] - 2e-9
        return part[r[reach]], c[reach], score[reach]

    def _merge(self, q: np.ndarray, nodes: np.ndarray, score: np.ndarray) -> None:
        """Take pairs into the k best of their queries."""
        touched = np.unique(q)
        held = np.isfinite(self.scores[touched])
        q = np.concatenate([np.repeat(touched, held.sum(axis=1)), q])
        nodes = np.concatenate([self.nodes[touched][held], nodes])
        score = np.concatenate([self.scores[touched][held], score])
        tie = nodes
        if nodes.dtype == object:
            tie = pd.factorize(nodes, sort=True)[0]
            tie[tie < 0] = len(nodes)  # null ids last
        order = np.lexsort((tie, -np.round(score, 9), q))
        by_q = q[order]
        rank = np.arange(len(by_q)) - np.searchsorted(by_q, by_q)
        order, by_q, rank = order[rank < self.k], by_q[rank < self.k], rank[rank < self.k]
        self.scores[by_q, rank], self.nodes[by_q, rank] = score[order], nodes[order]
        self.kth[touched] = self.scores[touched].min(axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, score): k rows per query, or all if fewer."""
        q, at = np.nonzero(np.isfinite(self.scores))
        return q, np.empty(0, object) if self.nodes is None else self.nodes[q, at], self.scores[q, at]


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    *,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    node_id: str = "node_id",
    node_vec: str = "embedding",
    exclude_self: bool = False,
    match: tuple[str, str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """V3: exact cosine top-k nodes per query -> (query_id, node_id, score, rank).

    ``exclude_self`` drops node == query (vector self-search); ``match``
    = (query column, node column) restricts each query to nodes whose column
    equals its own (search inside the collection chosen per query, R3): a task
    scores the vectors of each collection against that collection's queries only.
    Null and zero vectors are never hits; exactly k rows per query and task leave a task.
    """
    qkey = F.col(match[0]).cast("string") if match else F.lit("")
    nkey = F.col(match[1]).cast("string") if match else F.lit("")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv"), qkey.alias("qkey")).filter(F.col("qv").isNotNull())
    c = corpus.select(F.col(node_id).alias("node_id"), F.col(node_vec).alias("nv"), nkey.alias("nkey")).filter(F.col("nv").isNotNull())
    volume = q.agg(F.sum(F.size("qv").cast("long") * 8 + 32)).first()[0] or 0
    slices = max(1, -(-volume // slice_bytes))
    found = None
    for i in range(slices):
        part = q if slices == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        hits = _score_slice(part, c, k, exclude_self)
        found = hits if found is None else found.unionByName(hits)
    return rank_by_score(found, ["query_id"], k)


def _score_slice(q: DataFrame, c: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """k rows per task and query of one slice of queries (bounded by its byte size)."""
    pdf = q.toPandas()
    sent = q.sparkSession.sparkContext.broadcast((pdf["query_id"].to_numpy(object), pdf["qkey"].to_numpy(object), _matrix(pdf["qv"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, keys, Q = sent.value
        rows_of = pd.Series(np.arange(len(ids))).groupby(pd.Series(keys, dtype=object)).indices if len(ids) else {}
        best = Nearest(ids, Q, k, exclude_self)
        for b in batches:
            for key, at in b.groupby("nkey").indices.items():
                if key in rows_of:
                    best.add(np.asarray(rows_of[key]), b["node_id"].to_numpy()[at], _matrix(b["nv"].iloc[at]))
        q, node, score = best.rows()
        if len(q):
            yield pd.DataFrame({"query_id": ids[q], "node_id": node, "score": score})

    return c.mapInPandas(run, f"query_id {id_type(q, 'query_id')}, node_id {id_type(c, 'node_id')}, score double")


def centroids(vectors: DataFrame, key: str, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    """Mean vector per key (pointer vectors for two-hop retrieval, IVF cells).

    Element-wise mean via (key, position) aggregation: partial aggregation
    per task, so a key holding a third of all rows is pre-summed before the
    shuffle and never collected whole.
    """
    per_pos = (
        vectors.select(key, F.posexplode(vec).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return per_pos.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out)
    )
