import hashlib
from datetime import date, timedelta

import numpy as np

from bankrec.operators import anomaly

DIA = date(2026, 7, 21)
HISTORY = [-48, -50, -52, -49, -51, -47, -53, -50, -49.5, -50.5]


def mov(i, valor, dia, empresa="A", descricao="NORMAL"):
    return dict(id=i, dia=dia, empresa=empresa, descricao=descricao, valor=valor)


def outlier_rows():
    rows = [mov(i, v, DIA - timedelta(days=10 - i)) for i, v in enumerate(HISTORY)]
    return rows + [mov(90, -50, DIA), mov(91, -8000, DIA, descricao="MUITO FORA DO PADRAO")]


def test_outlier_is_flagged_and_typical_is_not(movimentos):
    got = anomaly.flag(movimentos(outlier_rows()), dia=DIA).collect()
    assert [r.descricao for r in got] == ["MUITO FORA DO PADRAO"]


def test_short_history_and_empty_day(movimentos):
    few = movimentos([mov(i, 10, DIA - timedelta(days=i)) for i in range(3)] + [mov(9, -9999, DIA)])
    assert anomaly.flag(few).count() == 0 and anomaly.eligible(few).count() == 0
    assert anomaly.flag(movimentos(outlier_rows()), dia=DIA + timedelta(days=1)).count() == 0


def test_constant_history_flags_nothing(movimentos):
    assert anomaly.flag(movimentos([mov(i, 5, DIA) for i in range(20)])).count() == 0


def test_hot_company_split_gives_the_same_flags(movimentos):
    rng = np.random.default_rng(0)
    rows = [mov(i, round(float(rng.normal(100, 20)), 2), DIA, "QUENTE" if i % 3 else f"C{i % 9}") for i in range(600)]
    df = movimentos(rows)
    plain = {(r.id, r.score) for r in anomaly.flag(df).collect()}
    split = {(r.id, r.score) for r in anomaly.flag(df, min_rows=5, rows_per_part=20).collect()}
    again = {(r.id, r.score) for r in anomaly.flag(df.repartition(7)).collect()}
    assert plain == split == again and 0.05 < len(plain) / 600 < 0.13


def test_forest_scores(movimentos):
    rng = np.random.default_rng(1)
    values = [round(float(v), 2) for v in rng.normal(0, 1, 300)] + [50.0, -40.0]
    got = anomaly.fit(movimentos([mov(i, v, DIA) for i, v in enumerate(values)])).first()
    assert len(got.notas) == len(got.alturas) == len(got.cortes) + 1
    assert (np.diff(got.cortes) > 0).all()
    at = lambda x: got.notas[np.searchsorted(got.cortes, round(x * 100), side="left")]
    assert at(50.0) < at(0.0) and at(-40.0) < at(0.0)
    assert all(-1 <= v < 0 for v in got.notas)
    # mean path length of the sample, known in expectation, keeps typical scores near -0.5
    assert 0.4 < -np.mean([at(v) for v in values]) < 0.6


def _walk(times, level, out, first=0):
    """One node after another."""
    if len(times) and level < anomaly.LEVELS:
        cut = int(np.argmin(times))
        out[first + cut] = level
        _walk(times[:cut], level + 1, out, first)
        _walk(times[cut + 1:], level + 1, out, first + cut + 1)


def test_depths_equal_a_walk():
    rng = np.random.default_rng(3)
    trees = [rng.integers(0, 40, n).astype(float) for n in (0, 1, 0, 5, 255, 30, 0)] + [np.arange(200.0), np.zeros(9)]
    want = []
    for t in trees:
        out = np.full(len(t), anomaly.LEVELS)
        _walk(t, 0, out)
        want.extend(out)
    sizes = np.array([len(t) for t in trees])
    assert anomaly.depths(np.concatenate(trees), sizes).tolist() == want


def test_forest_equals_a_literal_one(movimentos):
    """Every tree walked node by node, and each amount down every tree."""
    values = sorted({round(float(v), 2) for v in np.random.default_rng(4).normal(0, 10, 30)})
    copies = values + values[:7]
    got = anomaly.fit(movimentos([mov(i, v, DIA) for i, v in enumerate(copies)])).first()
    cents = sorted(round(v * 100) for v in copies)
    lengths, limit = anomaly.fixed_lengths(), int(np.ceil(np.log2(len(cents))))
    distinct = sorted(set(cents))
    start = {v: 1 + int(hashlib.md5(f"{anomaly.SEED}/A/{v}".encode()).hexdigest()[:15], 16) % (anomaly.PRIME - 1) for v in distinct}
    total = dict.fromkeys(distinct, 0)
    for mt, mc in zip(anomaly.multipliers(1), anomaly.multipliers(2)):
        draw = lambda v, m: (start[v] * m) % anomaly.PRIME / anomaly.PRIME
        following = dict(zip(distinct, distinct[1:]))
        time = {v: -np.log(draw(v, mt)) / (w - v) for v, w in following.items()}
        for x in distinct:
            node, depth = distinct, 0
            while depth < limit and len(node) > 1:
                at = min(node[:-1], key=time.get)
                cut = at + int((following[at] - at) * draw(at, mc))
                node, depth = [v for v in node if (v <= at) == (x <= cut)], depth + 1
            total[x] += depth * anomaly.ONE + lengths[sum(c in node for c in cents)]
    for x in distinct:
        assert got.alturas[np.searchsorted(got.cortes, x, side="left")] == total[x]
