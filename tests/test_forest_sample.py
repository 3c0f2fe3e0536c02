"""Rows of a forest: each tree's are the first of the whole history in its own order."""

import hashlib
from datetime import date

import pytest

from bankrec.operators import anomaly


def _start(i):
    return 1 + int(hashlib.md5(f"{anomaly.SEED}/{i}".encode()).hexdigest()[:15], 16) % (anomaly.PRIME - 1)


@pytest.mark.parametrize("n", [9, 200, 3000])
def test_trees_draw_from_the_whole_history(movimentos, n):
    rows = [dict(id=i, dia=date(2026, 7, 21), empresa="A", descricao="x", valor=i) for i in range(n)]
    got = anomaly.samples(movimentos(rows)).collect()
    if n < anomaly.MIN_HISTORY:
        assert got == []
        return
    trees = [[x.v for x in t.amostra] for t in got[0].arvores]
    if n <= anomaly.TREE_ROWS:
        assert trees == [[100 * i for i in range(n)]]
        assert [x.ate for x in got[0].arvores[0].amostra] == list(range(1, n + 1))
        return
    assert len(trees) == anomaly.TREES and len({x for t in trees for x in t}) > 0.99 * n
    for tree, step in enumerate(anomaly.multipliers(0)):
        first = sorted(range(n), key=lambda i: (_start(i) * step % anomaly.PRIME, i))[:anomaly.TREE_ROWS]
        assert trees[tree] == sorted(100 * i for i in first)
