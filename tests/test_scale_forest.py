"""Forests stay in the task that grows them; only samples and heights travel."""

from datetime import date

import numpy as np
import pytest

from bankrec.operators import anomaly


@pytest.mark.parametrize("n", [40, 700])
def test_heights_are_those_of_the_forest_and_no_cut_is_shuffled(movimentos, n):
    values = [round(float(v), 2) for v in np.random.default_rng(n).normal(0, 30, n)]
    rows = [dict(id=2000 * k + i, dia=date(2026, 7, 21), empresa=f"C{k}", descricao="x", valor=v + k)
            for k in range(3) for i, v in enumerate(values[:n - 9 * k])]
    df = movimentos(rows)
    scored = anomaly.score_amounts(df)
    assert "corte" not in scored._jdf.queryExecution().executedPlan().toString()
    forests = {r.empresa: r for r in anomaly.fit(df).collect()}
    assert set(forests) == {"C0", "C1", "C2"}
    got = scored.collect()
    assert sum(r.n for r in got) == len(rows)
    for r in got:
        at = np.searchsorted(forests[r.empresa].cortes, r.centimos, side="left")
        assert (r.altura, r.nota) == (forests[r.empresa].alturas[at], forests[r.empresa].notas[at])
