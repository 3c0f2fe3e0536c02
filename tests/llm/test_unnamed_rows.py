"""Rows without an id are in no group of op1."""

import re

from bankrec.llm import substring_dedup


def test_rows_without_id_come_back_whole_and_ungrouped(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, f" {text}\n")] * 300 + [(None, None), (None, " \n"), (1, text), (2, f"{text} tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = substring_dedup.remove_repeated(docs, chunk_bytes=2000)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept, len(r.spans)) for r in done.collect()))
    assert got == [(0, 0, 0, "", 0)] * 2 + [(0, 30, 0, text, 0)] * 300 + [(1, 30, 0, text, 0), (2, 31, 30, "tail", 1)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.findall(r"AS chunk#.*\n.*", plan)
    assert dealt and all("isnotnull(doc_id" in d for d in dealt)
