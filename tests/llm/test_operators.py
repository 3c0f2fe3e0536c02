"""The text operators on small tables: odd rows, brute force, and the tokenizer library."""

from pathlib import Path

import pytest

import corpus_pipeline
from bankrec.llm import (decontaminate, jaccard_join, language_id, line_dedup, line_quality, piece_codec,
                         quality_classifier, queries, ring_shards, substring_dedup, token_counts)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row string, chunk string, kept string, ids string, n_words string, class string")
PASSAGE = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    (1, f"intro one two three\n{PASSAGE}\nend of first"), (2, f"other start {PASSAGE} tail"), (2, f"other start {PASSAGE} tail"),
    (3, None), (4, ""), (5, " \n\t "), (None, PASSAGE), (6, PASSAGE.upper()), (7, PASSAGE + " more"),
    (8, "x" * 500 + "  ▁é😀\n<s> a"), (9, "a b c"), (10, "A B c"), (11, "one line\n" * 5), (12, "word " * 6000),
]
MODEL = queries.model_bytes() if Path("/opt/tokenizers/piece_bpe_32k.model").exists() else None


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i else None, "s" if t else None, len(t or ""), *"abcdef") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, nothing):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeated(docs).collect())
    seen = {}
    for i, t in TEXTS:
        ws = (t or "").split()
        for a in range(len(ws) - 12):
            if i is not None:
                seen[tuple(ws[a:a + 13])] = min(i, seen.get(tuple(ws[a:a + 13]), i))
    want = []
    for i, t in TEXTS:
        ws = (t or "").split()
        gone = {p for a in range(len(ws) - 12) if i is not None and seen[tuple(ws[a:a + 13])] < i for p in range(a, a + 13)}
        want.append((i or 0, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    assert got == sorted(want)
    assert substring_dedup.remove_repeated(nothing).count() == 0


def _sets():
    out = {}
    for i, t in TEXTS:
        ws = (t or "").lower().split()
        if i is not None:
            out[i] = {tuple(ws[a:a + 5]) for a in range(max(1, len(ws) - 4))} if ws else set()
    return out


def test_classes(docs, nothing):
    sets = _sets()
    least = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = min(least[i], least[j])
    for parameters in ({}, {"block_sets": 1, "block_tokens": 10}):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_alike(docs, **parameters).collect()}
        assert got == {(i, len(s), least[i]) for i, s in sets.items()} | {(None, 36, None)}
    assert jaccard_join.join_alike(nothing).count() == 0


def test_lines(docs, nothing):
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_repeated(docs).collect()}
    assert got[11] == (4, "one line\n") and got[3] == (0, None) and got[4] == (0, "")
    assert len(got) == 13 and line_dedup.remove_repeated(nothing).count() == 0


def test_quality(docs, nothing):
    got = {r.doc_id: r for r in line_quality.assess(docs).collect()}
    assert got[3].base_failed and got[3].n_words == 0 and got[12].n_repeat_words == 6000 and not got[12].kept
    assert got[2].kept and got[11].n_dup_lines == 4
    assert {r.doc_id for r in line_quality.clean(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert not line_quality.assess(docs, line_docs=0, line_percent=0).where("kept").count()
    assert line_quality.assess(nothing).count() == 0


def test_shards(docs, nothing):
    rows = ring_shards.assign(docs, shards=4).collect()
    assert len(rows) == len(TEXTS) and {r.grown_shard for r in rows} == {None}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert ring_shards.assign(nothing).count() == 0


def test_benchmark(spark, docs, nothing):
    items = spark.createDataFrame([(1, PASSAGE.upper().replace(" ", ", ")), (2, None), (3, "B c"), (3, "B c"), (None, "")],
                                  "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.report(docs, items).collect()}
    assert got[2] == (40, ["1"]) and got[9] == (2, ["3"]) and got[3] == (0, []) and got[11] == (0, [])
    left = {r.doc_id: r.text for r in decontaminate.clean(docs, items, max_hit_percent=99).collect()}
    assert left[9] == "a" and left[7] == " more" and None not in left and left[4] == ""
    assert decontaminate.report(docs, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.report(nothing, items).count() == 0


@pytest.mark.skipif(MODEL is None, reason="no vocabulary")
def test_pieces(docs, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = sorted((i or 0, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in TEXTS)
    counted = token_counts.count_tokens(docs, MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted) == want
    back = piece_codec.round_trip(docs, MODEL).collect()
    assert {(r.doc_id, None if r.ids is None else tuple(r.ids), r.decoded) for r in back} == {
        (i, None if t is None else tuple(lib.encode(t)), None if t is None else lib.decode(lib.encode(t))) for i, t in TEXTS}
    assert token_counts.count_tokens(nothing, MODEL).count() == piece_codec.round_trip(nothing, MODEL).count() == 0


def test_models_without_anything_to_learn(docs, nothing):
    assert language_id.learn(nothing) is None
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] == "en"
    marks = docs.selectExpr("doc_id", "1 as quality")
    assert quality_classifier.learn(docs, marks) is None
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.5}


@pytest.mark.skipif(MODEL is None, reason="no vocabulary")
def test_pipeline_stages_take_effect(spark):
    """Each stage against what its operator's report says of its own input."""
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    kept = corpus_pipeline.quality(spark, docs, sf)
    ids = {r.doc_id for r in line_quality.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == ids
    one = {r.doc_id for r in corpus_pipeline.one_of_each_class(spark, docs, sf).collect()}
    assert one == {r.component_id for r in jaccard_join.join_alike(docs).collect()}
    clean = corpus_pipeline.without_benchmark(spark, docs, sf)
    again = decontaminate.report(clean, queries.table(spark, sf, "benchmark")).where("n_hit >= 10")
    assert clean.columns == docs.columns and again.count() == 0
