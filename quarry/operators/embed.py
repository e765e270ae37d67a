"""Text -> vector (V1, U4).

Embedding models are not part of the library: vectors come in as an
``ARRAY<FLOAT>`` column, or a user model is plugged in with ``embed_with``
(iterator-style ``mapInPandas``: the model is built once per task and fed
Arrow batches).  Two model-free featurizers are built in: ``token_vectors``, a
fixed-width signed hash of the tokens that SQL can repeat, used for every text
of the dense queries; and ``hashing_embed`` from ``pyspark.ml``: hashed term
counts -> IDF -> L2 normalisation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from quarry.functions.text import tokenize


def hashing_embed(docs: DataFrame, num_features: int = 1 << 18, id_col: str = "node_id", text: str = "text") -> DataFrame:
    """Sparse TF-IDF unit vectors (ML ``Vector``): (id, embedding).

    ``IDF.fit`` is one distributed aggregation (document frequency per hash
    bucket); the transform is a per-row projection.
    """
    tok = docs.select(F.col(id_col), tokenize(text).alias("tokens"))
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features).transform(tok)
    tfidf = IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)
    return Normalizer(inputCol="tfidf", outputCol="embedding", p=2.0).transform(tfidf).select(id_col, "embedding")


def sparse_norms(vectors: DataFrame, id_col: str = "node_id", vec: str = "embedding") -> DataFrame:
    """(id, nnz, norm) of ML vectors, from their stored entries: a sparse vector is never unfolded."""

    # the struct behind an ML vector holds its stored entries in ``values``
    entries = unwrap_udt(F.col(vec))["values"]
    return vectors.select(
        id_col,
        F.size(F.filter(entries, lambda x: x != 0)).cast("bigint").alias("nnz"),
        F.round(F.sqrt(F.aggregate(entries, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"),
    )


def token_vectors(docs: DataFrame, dims: int = 64, id_col: str = "node_id", text: str = "text") -> DataFrame:
    """(id, embedding): per token one slot and one sign from its md5, summed over the text.

    Slot: the first 4 hex digits mod ``dims``; sign: + if the fifth is below 8.
    Ids keep their type; a text without tokens (or null) has the zero vector,
    which is similar to nothing.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo: dict[str, tuple[int, float]] = {}
        for b in batches:
            out = []
            for tokens in b["tokens"]:
                v = np.zeros(dims)
                for t in tokens if tokens is not None else ():
                    hit = memo.get(t)
                    if hit is None:
                        if len(memo) > 500_000:
                            memo.clear()
                        h = hashlib.md5(t.encode()).hexdigest()
                        hit = memo[t] = int(h[:4], 16) % dims, 1.0 if int(h[4], 16) < 8 else -1.0
                    v[hit[0]] += hit[1]
                out.append(v.tolist())
            yield pd.DataFrame({id_col: b[id_col].to_numpy(object), "embedding": out})

    tokens = docs.select(F.col(id_col), tokenize(text).alias("tokens"))
    return tokens.mapInPandas(run, f"{id_col} {id_type}, embedding array<double>")


def embed_with(
    docs: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    *,
    id_col: str = "node_id",
    text: str = "text",
) -> DataFrame:
    """Plug in a user model: ``model_factory()`` runs once per task and returns
    a function from a list of texts to an (n, d) array."""

    def run(batches):
        model = model_factory()
        for b in batches:
            vecs = model(b[text].fillna("").tolist()) if len(b) else np.zeros((0, 0))
            yield pd.DataFrame({id_col: b[id_col], "embedding": [np.asarray(v, dtype=np.float32).tolist() for v in vecs]})

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {id_type}, embedding array<float>")
