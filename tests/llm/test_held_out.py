"""What the classifiers learn from, and how well they do on what they did not see."""

import zlib

import pytest
from pyspark.sql import functions as F

from bankrec.llm import language_id, quality_classifier, queries


def test_rows_without_id_are_not_held_out(spark):
    docs = spark.createDataFrame([(k,) for k in [None, *range(50)]], "doc_id long")
    for modulus, remainder in ((3, 1), (4, 2)):
        got = docs.select("doc_id", language_id.held_out(modulus, remainder).alias("apart")).collect()
        assert all(r.apart == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in got)


def test_copies_and_a_frequent_language_send_little(spark, monkeypatch):
    """A third of the rows is one text, and nine of ten others are of one language."""
    seen = []
    monkeypatch.setattr(language_id, "train", lambda windows, targets, labels, seed: seen.append((len(windows), sorted(
        {k: int((targets == k).sum()) for k in range(len(labels))}.values()))))
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 10 = 0, 'b', 'a') as lang",
                                        "if(id % 3 = 0, 'one text', concat('text number ', id)) as text")
    language_id.learn(docs, sample_texts=200)
    assert seen == [(400, [200, 200])]


def test_long_texts_are_bounded_by_features(spark):
    """Features bound the sample, not rows alone; the model still tells the classes apart."""
    rows = [(i, " ".join(("ab" if i % 2 else "xy") + str((i * 7919 + k) % 5000) for k in range(20_000 if i < 4 else 60))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model = quality_classifier.learn(docs, marks, sample_features=12_000)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert sum((s > 0.5) == bool(i % 2) for i, s in got.items()) >= 150
    assert quality_classifier.learn(docs, marks, sample_features=1) is None
    few = quality_classifier.learn(docs, marks, counted_texts=80)
    assert few is not None and len(few.weights) == 1 << quality_classifier.BITS


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_accuracy_on_what_was_held_out(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = queries.table(spark, folder, "documents")
    lang = queries.op6_language_id(spark, folder).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    right = lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    marks = queries.table(spark, folder, "labels").select("doc_id", "quality")
    scored = queries.op8_quality_classifier(spark, folder).where("held_out").join(marks, "doc_id")
    good = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95 and good >= 0.95, (right, good)
