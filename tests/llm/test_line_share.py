"""The frequent lines of the pipeline in hosts of every size, with its own limits."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bankrec.llm import line_quality

NOTICE = "please share this page with all your good friends"
BODY = "concat_ws(' ', transform(sequence(0, 11), k -> concat('w', host, 'x', i, 'y', k)))"


@pytest.mark.parametrize("host, size, shared", [("small", 20, 6), ("middle", 500, 65), ("hot", 60_000, 1_100)])
def test_boilerplate_goes_in_hosts_of_every_size(spark, host, size, shared):
    """Documents up to ``shared`` have the notice; of number 0 little else is left."""
    docs = spark.range(size).selectExpr("id as doc_id", "id as i", f"'{host}' as host").selectExpr(
        "doc_id", "host as source",
        f"case when i = 0 then concat('only ', i, ' this\\n{NOTICE}') "
        f"when i < {shared} then concat({BODY}, '\\n{NOTICE.upper()}') else {BODY} end as text")
    docs = docs.unionByName(spark.createDataFrame([(-1, host, "a b c d e f g h i j k l\nnobody else says this")], docs.schema))
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.where(f"lower(text) like '%{NOTICE}%'").count() == 0
    changed = docs.join(kept.withColumnRenamed("text", "left"), "doc_id", "left").where("left is null or left <> text")
    assert {r.doc_id for r in changed.select("doc_id").collect()} == set(range(shared))
    assert [r.doc_id for r in changed.where("left is null").collect()] == [0]


def test_a_line_on_a_few_documents_stays(spark):
    rows = [(i, "s", " ".join(f"w{i}x{k}" for k in range(12)) + (f"\n{NOTICE}" if i < 4 else "")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(map(tuple, corpus_pipeline.quality(spark, docs, "").collect())) == rows


@pytest.mark.parametrize("size, shared", [(20, 6), (100, 5), (500, 65), (60_000, 1_100)])
def test_defaults_act_in_hosts_of_every_size(spark, size, shared):
    """The operator's own limits: a notice on some documents of a host is found in each of them."""
    docs = spark.range(size).selectExpr("id as doc_id", "'h' as source", "id as i", "'h' as host").selectExpr(
        "doc_id", "source", f"case when i < {shared} then concat({BODY}, '\\n {NOTICE.upper()}') else {BODY} end as text")
    words = len(NOTICE.split())
    got = line_quality.assess(docs).select("doc_id", "n_line_words", "kept").collect()
    assert {r.doc_id for r in got if r.n_line_words == words} == set(range(shared)) and all(r.kept for r in got)
    assert sum(r.n_line_words for r in got) == words * shared


def test_defaults_act_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert line_quality.assess(docs).where("n_line_words > 0").count() > 0


def test_names_of_a_caller_stay(spark):
    """Columns with the names that the operator uses inside come back as they were."""
    names = ("row", "key", "all", "lines", "place", "host", "document", "kept", "n_words", "__words", "__grams")
    rows = [(i, "s", " ".join(f"w{i}x{k}" for k in range(12)) + f"\n{NOTICE}") for i in range(30)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({n: F.lit(n) for n in names})
    got = line_quality.clean(docs)
    assert got.columns == docs.columns and got.count() == 30
    assert got.select(*names).distinct().collect() == [tuple(names)]
    assert got.where("text like '%please%'").count() == 0
