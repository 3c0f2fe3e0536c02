"""Columns of a caller keep their names and values through every stage of the pipeline."""

import corpus_pipeline
from bankrec.llm import decontaminate, line_dedup
from pyspark.sql import functions as F

NAMES = ("key", "all", "row", "covered", "lines", "n_removed", "ids", "n_tokens", "same", "decoded", "a", "class", "component_id",
         "__row", "__key", "__all", "__a", "__covered", "item_ids", "place", "host", "x y")


def _docs(spark):
    passage = "\n".join(f"line {k} of a passage that two documents share" for k in range(4))
    rows = [(i, f"{passage if i in (3, 7) else ''}\n" + " ".join(f"w{i}x{k}" for k in range(30)), "s") for i in range(12)] + [
        (None, None, None), (20, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def test_every_stage(spark):
    docs = _docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns[:len(docs.columns)] == docs.columns, name
        rows = out.where("doc_id is not null").collect()
        assert rows, name
        for r in rows:
            assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES], name
        if out.columns != docs.columns:
            assert out.columns[len(docs.columns):] == ["ids_", "n_tokens_", "same_"]
            assert all(r["same_"] and r["n_tokens_"] == len(r["ids_"]) for r in rows)
            assert out.where("text is null and (n_tokens_ is not null or same_ is not null)").count() == 0


def test_operators_name_what_they_add(spark):
    docs = _docs(spark)
    out = line_dedup.remove_repeated(docs)
    assert out.columns == [*docs.columns, "n_removed_"]
    got = {r.doc_id: (r["n_removed"], r["n_removed_"]) for r in out.collect()}
    assert got[7] == ("n_removed7", 4) and got[3] == ("n_removed3", 0)
    items = spark.createDataFrame([("i", " ".join(f"w5x{k}" for k in range(10)))], "item_id string, text string")
    cleaned = {r.doc_id: r.text for r in decontaminate.clean(docs, items).collect()}
    assert "w5x0" not in cleaned[5].split() and "w5x10" in cleaned[5].split() and cleaned[20] == ""


def test_a_text_of_very_many_lines(spark):
    """Work in proportion to the lines, all of them covered in the second copy."""
    text = "\n".join(f"line number {k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nand one more")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_repeated(docs).collect()}
    assert got == {1: (0, text), 2: (60_000, "and one more")}
