import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from quarry.llm import toxicity as tx

MASK = (1 << 64) - 1


def plain_slots(text):
    """The docstring's features, one at a time."""
    words = re.findall(r"\w+", text.lower())
    code = lambda w, n=None: zlib.crc32(f"{n or ''}{w[:n]}".encode()) + 1
    golden = int(tx.GOLDEN)
    out = set()
    for i, w in enumerate(words):
        out.add(code(w) * golden & MASK)
        out |= {code(w, n) * golden & MASK for n in tx.STEMS if len(w) > n}
        for gap in tx.GAPS:
            if i + gap < len(words):
                out.add(((code(w) * golden & MASK) ^ (code(words[i + gap]) + (gap << 33))) * golden & MASK)
    return sorted({h >> (64 - tx.BITS) for h in out})


@pytest.mark.parametrize("text", ["", "word", "Two words", "a b c d e f g a b c", "Straßenbahnen fahren, übermäßig_lang 42x!", "x " * 500 + "end"])
def test_features(text, monkeypatch):
    assert tx.Featurizer().slots(text).tolist() == plain_slots(text)
    monkeypatch.setattr(tx, "KNOWN_WORDS", 2)
    f = tx.Featurizer()
    assert f.slots("other words first of all").size and f.slots(text).tolist() == plain_slots(text)


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    z, n = {}, {}

    def weight(i):
        a, b = (0.0, 0.0) if i == tx.SLOTS else (l1, l2)
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= a else -(zi - math.copysign(a, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + b)

    for _ in range(epochs):
        for label, slots in rows:
            at = [*slots, tx.SLOTS]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for i, wi in zip(at, w):
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_against_scalar_version():
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 60, rng.integers(0, 9)))) for _ in range(200)]
    got = tx.fit_ftrl(rows, 3, 0.5, 1.0, 1.0, 0.3)
    want = plain_ftrl([(y, s.tolist()) for y, s in rows], 3, 0.5, 1.0, 1.0, 0.3)
    assert set(np.flatnonzero(got).tolist()) == set(want) and all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    assert 0 < len(want) < 60


def test_calibration_minimises_log_loss():
    rng = np.random.default_rng(1)
    logit = rng.normal(size=6000) * 3
    toxic = (rng.random(6000) < 1 / (1 + np.exp(-logit))).astype(float)
    slope, intercept = tx.calibrate(4 * logit + 2, toxic, np.ones(6000))
    assert abs(slope - 0.25) < 0.03 and abs(intercept + 0.5) < 0.15
    slope, intercept = tx.calibrate(np.array([5.0, 6.0]), np.array([1.0, 1.0]), np.ones(2))
    assert math.isfinite(slope) and math.isfinite(intercept)


def test_held_out_documents_of_the_corpus(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    out = tx.op11_toxicity(spark, sf)
    assert [f"{n} {t}" for n, t in out.dtypes] == ["doc_id bigint", "held_out boolean", "score double", "predicted int"]
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted for r in held if r.toxic == 1]) > 0.85
    assert np.mean([r.predicted for r in held if r.toxic == 0]) < 0.02
    assert abs(np.mean([r.score for r in held]) - np.mean([r.toxic for r in held])) < 0.03


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet").select("doc_id", "toxic")
    spoiled = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.train(docs.where(~tx.held_out()), x.where(~tx.held_out()), l1=1.0) for x in (labels, spoiled.repartition(3)))
    assert len(a.slots) and (a.slots == b.slots).all() and (a.weights == b.weights).all() and (a.bias, a.slope, a.intercept) == (b.bias, b.slope, b.intercept)


def example(spark):
    rows = [(i, f"some plain words number {i}" + (" you idiot" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    return docs, labels


def test_parts_draws_repeats_and_conflicts(spark):
    docs, labels = example(spark)
    few = tx.train(docs, labels, per_class=60, part_texts=30, l1=0.5)  # clean texts drawn at 30 %, toxic ones at 60 %
    assert len(few.slots)
    got = {r.doc_id: r for r in tx.predict(docs, few).collect()}
    assert all(r.predicted == (i % 3 == 0) for i, r in got.items())
    # repeated documents and repeated or null labels change nothing, a second label makes an id toxic
    again = tx.train(docs.unionByName(docs.where("doc_id < 40")), labels.unionByName(labels).unionByName(labels.withColumn("toxic", F.lit(None).cast("int"))), per_class=60, part_texts=30, l1=0.5)
    assert (again.slots == few.slots).all() and np.allclose(again.weights, few.weights)
    both = tx.labelled_ids(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int"), "doc_id", "toxic")
    assert {tuple(r) for r in both.collect()} == {(1, 1), (2, 0)}


def test_edge_rows(spark):
    docs, labels = example(spark)
    model = tx.train(docs, labels, l1=0.5)
    rows = [(1, None, 0.5, "a"), (2, "", 0.5, "b"), (3, "you idiot", 0.5, None), (3, "you idiot", 0.5, None), (None, "plain words " * 200_000, 0.5, "c"), (4, "!? ...", 0.5, "d")]
    out = tx.predict(spark.createDataFrame(rows, "doc_id long, text string, score double, extra string"), model)
    assert sorted(out.columns) == ["doc_id", "extra", "predicted", "score", "text"]
    got = out.collect()
    assert len(got) == 6 and [r.predicted for r in got if r.doc_id == 3] == [1, 1]
    empty = {r.score for r in got if r.doc_id in (1, 2, 4)}
    assert len(empty) == 1 and 0 < min(empty) < 1
    assert tx.predict(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs, labels = example(spark)
    for given, score in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        r = tx.predict(docs, tx.train(docs, given)).first()
        assert (r.score, r.predicted) == (score, int(score))
    lost = tx.train(docs.limit(0), labels)  # labels without a document
    assert 0 <= tx.predict(docs, lost).first().score <= 1
