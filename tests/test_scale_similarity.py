"""Vectors are sent as they come, once to each block of a bundle of cells."""

import re

import numpy as np
import pytest

from bankrec.operators import similarity
from test_similarity import brute


@pytest.mark.parametrize("kind,block", [("float", 7), ("float", 90), ("double", 40)])
def test_bundles_are_exact_and_copy_little(spark, kind, block):
    rng = np.random.default_rng(4)
    base = [*rng.normal(0, 1, (300, 8)).astype("float32"), *[np.zeros(8, "float32")] * 3]
    frame = lambda rows: spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in rows], f"caso_id long, embedding array<{kind}>")
    resolved, opened = list(enumerate(base)), list(enumerate(base[::10])) + [(900, base[-1])]
    got = similarity.top_k(frame(opened), frame(resolved), 3, 32, block)
    assert sorted((r.caso_id, r.rank, r.vizinho_id, round(r.similaridade, 6)) for r in got.collect()) == brute(opened, resolved, 3)
    sent = re.search(r"FlatMapCoGroupsInPandas \[.*", got._jdf.queryExecution().executedPlan().toString())
    assert sent and "vetor" in sent[0] and dict(got.dtypes)["vizinho_id"] == "bigint"


def test_queries_are_copied_once_per_bundle():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (400, 16)).astype("float32")
    centres = similarity._unit(base[:32])
    batch = __import__("pandas").DataFrame({"caso_id": range(len(base)), "embedding": list(base)})
    cells = next(similarity._assign(centres, "<f4")(iter([batch]))).groupby("celula").agg(
        n=("id", "size"), p=("proximidade", "min")).reset_index()
    cells = [tuple(r) for r in cells.itertuples(index=False)]
    bundles = similarity._bundles(cells, 100)
    assert sorted(c for own in bundles.values() for c in own) == [c for c, *_ in cells] and 4 <= len(bundles) <= 8
    each = next(similarity._visits(centres, cells, 3)(iter([batch])))
    rows = list(similarity._visits(centres, cells, 3, bundles, "<f4")(iter([batch])))
    told = [(q, first + at) for r in rows for q, first, bits in zip(r["id"], r["grupo"], r["celulas"])
            for at in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))]
    assert sorted(told) == sorted(zip(each["id"], each["celula"]))
    assert sum(map(len, rows)) <= len(bundles) * len(base) < len(each) / 3
    assert {len(v) for r in rows for v in r["vetor"]} == {16 * 4}
