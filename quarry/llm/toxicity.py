"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by
FTRL-proximal (per-coordinate rates, L1 + L2), so that few weights are left to send.

- Features: words (runs of letters, digits and ``_``, lower-cased) of the whole
  text; single words and their first 4, 5 and 6 letters (truncation stems, for languages
  that compound), neighbouring pairs, and pairs with one or two words left out between
  them, hashed to ``2**BITS`` slots.  A slot counts once per text.
- Labels: an id labelled both ways counts as toxic.  The labelled ids are drawn by a
  hash of the id, up to ``per_class`` of each class in expectation, and sent to the
  texts (the draw is bounded by ``2 * per_class`` ids whatever the tables hold); a
  repeated row of a drawn document is taken once.
- Training: one in ``CALIBRATION`` drawn ids is set aside, the others are split by hash
  into parts of about ``part_texts`` texts.  Every part is fitted by a task of its own
  and the weights are averaged; the ids set aside calibrate slope and intercept of the
  averaged model on the log loss, each class weighted back to its share of all labelled ids.
- Scoring is one pass over the texts with the non-zero weights; nothing is shuffled.

Defined cases: a null text is an empty one; an empty text gets the calibrated
intercept; labels that are null, and labels without a document, teach nothing; if
the labels hold one class only, or none, every score is the share of toxic labels
(0 without any); repeated rows each give a row; an empty table gives an empty
result; a null id hashes like '' for the split; further columns pass through, of
the names ``score`` and ``predicted`` the new ones stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import add_columns, crc_mod, documents, map_rows, stored, text_key
from quarry.sources.tables import table

BITS = 18
SLOTS = 1 << BITS
#: Distances of the two words of a pair: neighbours, then skip-grams.
GAPS = (1, 2, 3)
#: A longer word also counts as its first letters, so that compounds and endings share a weight.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
CALIBRATION = 6
WORD = re.compile(r"\w+")
KNOWN_WORDS = 1 << 18  # hashes a task keeps at hand
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class KnownWords(dict):
    """word -> its number; row ``number`` of ``codes`` holds the hash of the word, then of its beginnings
    (0: as long as the word).  Starts anew when it holds ``KNOWN_WORDS``."""

    def __init__(self):
        super().__init__()
        self.codes = np.zeros((1 << 10, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.codes):
            self.codes = np.vstack([self.codes, np.zeros_like(self.codes)])
        self.codes[at] = [zlib.crc32(f"{n or ''}{word[:n]}".encode("utf-8", "surrogatepass")) + 1 if n is None or len(word) > n else 0 for n in (None, *STEMS)]
        return at


class Featurizer:
    """Distinct slots of a text, ascending."""

    def __init__(self):
        self.known = KnownWords()

    def slots(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if len(self.known) > KNOWN_WORDS:
            self.known = KnownWords()
        numbers = np.array(list(map(self.known.__getitem__, WORD.findall(text.lower()))), np.int64)
        words = self.known.codes[numbers, 0]
        single = self.known.codes[np.unique(numbers)].ravel()
        mixed = [single[single > 0] * GOLDEN]
        for gap in GAPS:
            mixed.append(((words[:-gap] * GOLDEN) ^ (words[gap:] + np.uint64(gap << 33))) * GOLDEN)
        return np.unique((np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int32))


def fit_ftrl(rows: list[tuple[int, np.ndarray]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights per slot (last: the bias, which is not penalised) of FTRL-proximal."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    first, second = np.full(SLOTS + 1, l1), np.full(SLOTS + 1, l2)
    first[SLOTS] = second[SLOTS] = 0.0

    def weights(at) -> np.ndarray:
        rest = np.abs(z[at]) - first[at]
        return np.where(rest > 0, -np.sign(z[at]) * rest / ((beta + np.sqrt(n[at])) / alpha + second[at]), 0.0)

    for _ in range(epochs):
        for label, slots in rows:
            at = np.append(slots, SLOTS)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(slice(None))


@dataclass
class Model:
    """score = sigmoid(slope * (bias + sum of the weights of a text's slots) + intercept);
    without ``slots`` every score is ``rate``."""

    rate: float
    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0

    def scorer(self):
        if not len(self.slots):
            return lambda text: self.rate
        dense, features = np.zeros(SLOTS), Featurizer()
        dense[self.slots] = self.weights

        def score(text: str | None) -> float:
            logit = self.slope * (self.bias + dense[features.slots(text)].sum()) + self.intercept
            return float(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))

        return score


def labelled_ids(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """(doc_id, toxic): one row per labelled id."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    return known.groupBy(F.col(id_column).alias("doc_id")).agg(F.max((F.col(label) != 0).cast("int")).alias("toxic"))


def drawn_texts(docs: DataFrame, ids: DataFrame, rates: dict[int, float], parts: int, seed: int) -> DataFrame:
    """(part, toxic, row_key, slots) of the documents of the drawn ids."""
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.when(F.col("toxic") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    # one in CALIBRATION ids is left for the calibration (the part after the last)
    part = F.when(F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id"), F.lit(CALIBRATION)) == 0, F.lit(parts)).otherwise(F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(parts))).cast("int")
    drawn = ids.where(share < rate).select(F.col("doc_id").alias("_drawn"), "toxic", part.alias("part"))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_drawn"))

    def vectors(batches: Iterator[dict]) -> Iterator[list]:
        features = Featurizer()
        for b in batches:
            yield [(i, t, p, text_key((x or "").encode()), features.slots(x).tolist()) for i, t, p, x in zip(b["doc_id"], b["toxic"], b["part"], b["text"])]

    rows = map_rows(texts.select("doc_id", "toxic", "part", "text"), vectors, "doc_id long, toxic int, part int, row_key long, slots array<int>")
    return rows.dropDuplicates(["doc_id", "row_key"]).select("part", "toxic", F.xxhash64("doc_id", "row_key").alias("row_key"), "slots")


def calibrate(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of least weighted log loss, by damped Newton steps with a weak pull to (1, 0)."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    at, pull = np.array([1.0, 0.0]), np.diag([1.0, 1e-3])

    def loss(v: np.ndarray) -> float:
        s = x @ v
        return float(weight @ (np.logaddexp(0.0, s) - toxic * s) + 0.5 * (v - [1.0, 0.0]) @ pull @ (v - [1.0, 0.0]))

    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -35, 35)))
        gradient = x.T @ (weight * (p - toxic)) + pull @ (at - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, gradient)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        if size <= 1e-6 or np.abs(step).max() < 1e-9:
            break
        at = at - size * step
    return float(at[0]), float(at[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 16_384,
    part_texts: int = 4_096,
    epochs: int = 2,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.5,
    seed: int = 11,
    label: str = "toxic",
) -> Model:
    """Fit on the documents (doc_id, text) of the labelled ids (doc_id, ``label``)."""
    ids = labelled_ids(labels, "doc_id", label)
    sizes = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(sizes.values())
    rate = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model(rate)
    rates = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    parts = max(1, round(sum(min(per_class, n) for n in sizes.values()) / part_texts))
    rows = stored(drawn_texts(docs, ids, rates, parts, seed), "toxicity-draw")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [(toxic, np.asarray(slots, np.int64)) for _, toxic, slots in sorted(zip(pdf["row_key"], pdf["toxic"], pdf["slots"]), key=lambda r: r[:2])]
        w = fit_ftrl(texts, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at.astype("int32"), "weight": w[at]})

    fitted = rows.where(F.col("part") < parts).groupBy("part").applyInPandas(fit, "slot int, weight double")
    dense = np.zeros(SLOTS + 1)
    for slot, weights in fitted.groupBy("slot").agg(F.sort_array(F.collect_list("weight"))).collect():  # at most SLOTS + 1 rows of ``parts`` weights
        dense[slot] = sum(weights) / parts
    at = np.flatnonzero(dense[:SLOTS])
    model = Model(rate, at.astype(np.int32), dense[at], float(dense[SLOTS]))
    sent = docs.sparkSession.sparkContext.broadcast(dense)

    def logits(batches: Iterator[dict]) -> Iterator[list]:
        for b in batches:
            yield [(t, float(sent.value[np.append(s, SLOTS).astype(int)].sum())) for t, s in zip(b["toxic"], b["slots"])]

    left = map_rows(rows.where(F.col("part") == parts).select("toxic", "slots"), logits, "toxic int, logit double").orderBy("logit", "toxic").toPandas()  # a part of the bounded draw
    weight = np.where(left["toxic"] == 1, 1.0 / rates[1], 1.0 / rates[0])
    if len(left):
        model.slope, model.intercept = calibrate(left["logit"].to_numpy(), left["toxic"].to_numpy(float), weight)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on) added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most SLOTS weights

    def start():
        score = sent.value.scorer()
        return lambda texts: [(s, int(s >= threshold)) for s in map(score, texts)]

    return add_columns(docs, text, start, "score double, predicted int")


def held_out(id_column: str = "doc_id") -> Column:
    return crc_mod(id_column, 4) == 2


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE: dict[str, str] = {}
