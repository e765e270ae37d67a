import numpy as np
from conftest import SF0001
from pyspark.sql import functions as F

from quarry.llm import lang_id


def test_gram_counts_hash_equal_grams_alike():
    a, b = lang_id.gram_counts("The  cat!!"), lang_id.gram_counts("the, CAT.")
    assert (a == b).all()
    assert lang_id.gram_counts(None) is None and lang_id.gram_counts("12 ..") is None
    # " the cat " has 9 + 8 + 7 grams, "é" three + two + one
    assert lang_id.gram_counts("thecat").sum() == 8 + 7 + 6
    assert lang_id.gram_counts("é").sum() == 3 + 2 + 1


def test_long_texts_count_whole(monkeypatch):
    text = "abc déf " * 5000
    whole = lang_id.gram_counts(text)
    monkeypatch.setattr(lang_id, "PIECE", 977)
    assert (lang_id.gram_counts(text) == whole).all()


def test_held_out_accuracy_and_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_id.op3_lang_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    # calibrated: mean score near accuracy
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == r.lang for r in held])) < 0.05


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    spoiled = docs.withColumn("lang", F.when(lang_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = lang_id.train(spoiled.where(~lang_id.held_out()).repartition(3))
    assert model.labels == again.labels and np.allclose(model.weights, again.weights) and model.temperature == again.temperature


def test_edge_rows(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(docs)
    german = docs.where("lang = 'de' and length(text) > 500").first().text
    rows = [(1, None, "a"), (2, "", "a"), (3, "42 !!", "a"), (4, "the of and that", "a"), (4, "the of and that", "a"), (None, german * 300, None)]
    out = lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == 6
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert [r.lang_pred for r in got if r.doc_id == 4] == ["en", "en"]
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = lang_id.train(empty)
    assert lang_id.predict(empty, model).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi jkl", "en")], "doc_id long, text string, lang string")
    r = lang_id.predict(one, lang_id.train(one)).first()
    assert (r.lang_pred, r.score) == ("en", 1.0)
    assert lang_id.predict(one.limit(0), model).count() == 0


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = [rng.choice(3, p=q) for q in p]
    assert abs(lang_id.fit_temperature([(y, 5 * x) for y, x in zip(labels, logits)]) - 5) < 0.5
