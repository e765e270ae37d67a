"""Language identification: sparse multinomial logistic regression on TF-IDF of
character n-grams, trained with FTRL-proximal (L1 + L2), then temperature scaling.

- Features: letters lower-cased, every run of other characters one blank; all
  1- to 3-grams of the whole text, hashed to ``2**BITS`` slots; (1 + ln tf) * idf,
  L2-normalised.
- Document frequencies cover every training text: each task counts into one
  fixed array and passes on its non-zero slots, which are summed.
- Weights are fitted on a bounded sample: up to ``per_language`` texts of each
  label, by hash.  ``shards`` tasks each run FTRL over a part of it and their
  weights are averaged; one more part is left for the temperature, the scalar
  that minimises the log loss of the averaged model on it.
- Prediction is one pass over the texts with the model (a fixed-size array per
  label) sent to every task; nothing is shuffled.

Defined cases: text null or without a letter gives ``und`` with score 0; without
any training text every prediction is ``und``; with a single label its score is
1; ties go to the first label in code-point order; repeated rows each give a row;
a null id hashes like '' for the split; an empty table gives an empty result;
further columns pass through untouched (``predict``) and are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import add_columns, crc_mod, documents, map_rows

BITS = 15
SLOTS = 1 << BITS
PIECE = 1 << 20
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of the whole text; None without a letter."""
    if not text:
        return None
    # the text goes through in pieces, so that the hashes of a long one need no room
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letters = letter_table()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, 32)
    keep = letters.copy()
    keep[0] = True
    keep[1:] |= letters[:-1]  # the first of a run of blanks
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    counts = np.zeros(SLOTS, np.int64)
    for i in range(0, len(points), PIECE):
        h = np.zeros(min(PIECE, len(points) - i), np.uint64)
        for n in range(3):
            part = points[i + n : i + n + len(h)]
            h = h[: len(part)]
            h = (h + part + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=SLOTS)
    return counts


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[slots])) * idf[slots]
    return slots, values / np.sqrt(values @ values)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights [slot, label] (last slot: bias) of follow-the-regularised-leader with elastic-net penalties."""
    z, n = np.zeros((SLOTS + 1, n_labels)), np.zeros((SLOTS + 1, n_labels))

    def weights(at) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for label, slots, values in rows:
            at, x = np.append(slots, SLOTS), np.append(values, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [slot, label], last slot: bias
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        slots, values = features(counts, self.idf)
        return values @ self.weights[slots] + self.weights[SLOTS]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.labels else None
        if counts is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(counts) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[dict]) -> Iterator[list]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts = gram_counts(text)
                if counts is not None:
                    df += counts > 0
                    n += 1
        yield [(-1, n), *((int(i), int(df[i])) for i in np.flatnonzero(df))]

    out, n = np.zeros(SLOTS), 0
    for slot, k in map_rows(texts.select("text"), count, "slot int, k long").groupBy("slot").agg(F.sum("k")).collect():  # at most SLOTS + 1 rows
        if slot < 0:
            n = k
        else:
            out[slot] = k
    return out, n


def train(
    labelled: DataFrame,
    per_language: int = 2000,
    shards: int = 8,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    seed: int = 7,
) -> Model:
    """Fit on ``labelled`` (text, lang); rows with a null lang are left out."""
    labelled = labelled.where(F.col("lang").isNotNull()).select("text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per label
    labels = sorted(sizes)
    df, n = document_frequencies(labelled)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    if not labels or not n:
        return Model([], idf, np.zeros((SLOTS + 1, 0)))
    spark = labelled.sparkSession
    # up to ``per_language`` texts of each label in expectation, by hash of the text: the same at every run
    draw = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_language / sizes[k]))]), F.col("lang"))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(shards + 1)).cast("int")
    sample = labelled.where(F.coalesce(draw, F.lit(0.0)) < rate).select("text", "lang", part.alias("part"))

    def vectors(batches: Iterator[dict]) -> Iterator[list]:
        for batch in batches:
            out = []
            for text, lang, p in zip(batch["text"], batch["lang"], batch["part"]):
                counts = gram_counts(text)
                if counts is not None:
                    slots, values = features(counts, idf)
                    out.append((p, labels.index(lang), slots.tolist(), values.tolist()))
            yield out

    rows = map_rows(sample, vectors, "part int, label int, slots array<int>, values array<double>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(zip(pdf["label"], pdf["slots"], pdf["values"]), key=lambda r: (xxhash.xxh3_64_intdigest(r[2].tobytes()), r[0]))  # an order that does not depend on the shuffle
        w = fit_ftrl(texts, len(labels), epochs, alpha, beta, l1, l2)
        slots, label = np.nonzero(w)
        return pd.DataFrame({"slot": slots.astype("int32"), "label": label.astype("int32"), "weight": w[slots, label]})

    fitted = rows.where(F.col("part") < shards).groupBy("part").applyInPandas(fit, "slot int, label int, weight double")
    weights = np.zeros((SLOTS + 1, len(labels)))
    for slot, label, w in fitted.groupBy("slot", "label").agg(F.sum("weight")).collect():  # at most slots * labels
        weights[slot, label] = w / shards
    model = Model(labels, idf, weights)
    left = [(r.label, np.array(r.slots), np.array(r["values"])) for r in rows.where(F.col("part") == shards).collect()]  # a part of the bounded sample
    model.temperature = fit_temperature([(label, values @ weights[slots] + weights[SLOTS]) for label, slots, values in left])
    return model


def fit_temperature(rows: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not rows:
        return 1.0
    label, logits = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), label]))

    lo, hi, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # slots * labels numbers

    def start():
        model = sent.value
        return lambda texts: [model.predict(t) for t in texts]

    return add_columns(docs, text, start, "lang_pred string, score double")


def held_out(id_column: str = "doc_id") -> Column:
    return crc_mod(id_column, 4) == 2


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_lang_id": op3_lang_id}
ORACLE: dict[str, str] = {}
