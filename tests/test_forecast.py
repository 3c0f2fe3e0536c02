from datetime import date, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from bankrec.operators import boosting, forecast, recursions, series

D0 = date(2026, 7, 1)


def long(spark, named):
    rows = [(n, i, D0 + timedelta(days=i), float(v)) for n, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "serie string, t long, dia date, valor double")


def mov(i, empresa, valor, day):
    return dict(id=i, dia=D0 + timedelta(days=day), empresa=empresa, descricao="x", valor=valor)


def week(n):
    return [100.0 if (D0 + timedelta(days=i)).weekday() < 5 else -50.0 for i in range(n)]


def test_short_series_are_rejected(spark):
    df = long(spark, {"a": [100, 105]})
    assert forecast.forecast(df).count() == 0
    assert forecast.too_short(df).first().n == 2


def test_trend(spark):
    df = long(spark, {"a": [100 + 10 * i for i in range(10)]})
    out = forecast.forecast(df, 3).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.dia):
        by.setdefault(r.modelo, []).append((r.dia, r.valor))
    assert {"regressao_linear", "media_movel", "suavizacao_exponencial", "arima"} <= set(by)
    for model in ("regressao_linear", "suavizacao_exponencial", "arima"):
        assert [v for _, v in by[model]] == pytest.approx([200, 210, 220], abs=0.5)
    assert [v for _, v in by["media_movel"]] == pytest.approx([170] * 3)
    assert [d.day for d, _ in by["arima"]] == [11, 12, 13]


def test_holdout_finds_the_trend_and_lists_failures(spark):
    df = long(spark, {"a": [100 + 10 * i for i in range(15)], "const": [50.0] * 12, "curta": [1.0] * 6})
    scores = forecast.backtest(df, 3)
    best = {r.serie: r for r in forecast.best_model(scores).collect()}
    assert set(best) == {"a", "const"}
    assert best["a"].rmse == pytest.approx(0, abs=0.5)
    assert best["const"].melhor_modelo == "regressao_linear"
    failed = scores.where("falha is not null").collect()
    assert {(r.serie, r.modelo) for r in failed} >= {("const", "markov_switching")}
    table = forecast.rmse_table(scores, "a").collect()
    assert [r.rmse_eur for r in table] == sorted(r.rmse_eur for r in table)


def test_constant_series_stay(spark):
    out = forecast.forecast(long(spark, {"c": [50.0] * 10}), 4).collect()
    assert all(r.valor == pytest.approx(50, abs=1e-6) for r in out)


def fitted(spark, model, rows, h):
    """What a recursive model says of each list of values."""
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(rows)], "i int, y array<double>")
    return [r.m for r in df.repartition(3).select("i", F.expr(model("y", h)).alias("m")).orderBy("i").collect()]


def test_regimes_stay_in_range(spark):
    rng = np.random.default_rng(42)
    y = np.concatenate([100 + rng.normal(0, 5, 8) if b % 2 == 0 else 500 + rng.normal(0, 5, 8) for b in range(4)])
    out, flat, odd = fitted(spark, recursions.markov, [y, [7.0] * 9, [0.0] * 20 + [1e9]], 3)
    assert out.falha is None and all(-50 < v < 600 for v in out.valores)
    assert out.valores[0] > out.valores[2] > 300
    assert flat.falha == "variância nula" and flat.valores is None
    assert odd.falha or all(np.isfinite(odd.valores))


def holt_sse(y, a, b, level, trend):
    total = 0.0
    for v in y:
        e = v - level - trend
        total += e * e
        level, trend = level + trend + a * e, trend + a * b * e
    return total, level, trend


def holt_fit(y, a, b):
    """The best start values by least squares on the errors, which are affine in them."""
    def errors(level, trend):
        out = []
        for v in y:
            e = v - level - trend
            out.append(e)
            level, trend = level + trend + a * e, trend + a * b * e
        return np.array(out)

    base = errors(0, 0)
    x = np.linalg.lstsq(np.stack([errors(1, 0) - base, errors(0, 1) - base], axis=1), -base, rcond=None)[0]
    return holt_sse(y, a, b, *x)


def test_holt_is_the_best_of_its_grids(spark):
    rng = np.random.default_rng(3)
    rows = [rng.normal(0, 1, n).cumsum() for n in (6, 12, 20, 20)]
    for y, got in zip(rows, fitted(spark, recursions.holt, rows, 4)):
        points = [(0.05 + 0.18 * i, 0.05 + 0.18 * j) for i in range(6) for j in range(6)]
        for step in (0.09, 0.045, 0.0225, None):
            a, b = min(points, key=lambda p: holt_fit(y, *p)[0])
            points = [tuple(min(0.99, max(0.01, c + k * step)) for c, k in ((a, i), (b, j))) for i in (0, -1, 1) for j in (0, -1, 1)] if step else []
        _, level, trend = holt_fit(y, a, b)
        assert got.valores == pytest.approx([level + trend * (i + 1) for i in range(4)], rel=1e-4, abs=1e-4)


def css(w, p, t, d):
    e, total = 0.0, 0.0
    for before, now in zip(w, w[1:]):
        e = (now - d) - p * (before - d) - t * e
        total += e * e
    return total, e


def test_arima_is_the_best_of_its_grids(spark):
    rng = np.random.default_rng(5)
    rows = [rng.normal(1, 1, n).cumsum() for n in (8, 15, 30)]
    for y, got in zip(rows, fitted(spark, recursions.arima, rows, 3)):
        w = np.diff(y)

        def drift(p, t):       # errors are affine in the drift, so three values give the parabola
            e0, e1, e2 = (css(w, p, t, d)[0] for d in (-1, 0, 1))
            return (e0 - e2) / (2 * (e0 + e2 - 2 * e1))

        points = [(0.15 * i, 0.15 * j) for i in range(-6, 7) for j in range(-6, 7)]
        for step in (0.05, 0.0125, None):
            p, t = min(points, key=lambda q: css(w, *q, drift(*q))[0])
            points = [tuple(min(0.99, max(-0.99, c + k * step)) for c, k in ((p, i), (t, j)))
                      for i in range(-2, 3) for j in range(-2, 3)] if step else []
        d = drift(p, t)
        step, level, want = w[-1], y[-1], []
        e = css(w, p, t, d)[1]
        for _ in range(3):
            step, e = d + p * (step - d) + t * e, 0.0
            level += step
            want.append(level)
        assert got.valores == pytest.approx(want, rel=1e-5, abs=1e-5)
    short, flat = fitted(spark, recursions.arima, [[1, 2, 3], [5.0] * 8], 2)
    assert short.falha == "série demasiado curta" and flat.valores == pytest.approx([5, 5])


def markov_fit(y, h):
    """The rounds of the regimes with plain loops."""
    y = np.asarray(y, float)
    clip = lambda x: min(1 - 1e-12, max(1e-12, x))
    floor, high = 1e-8 * y.var(), (y > np.median(y)).astype(float)
    a, b, start = 0.1, 0.9, 0.5
    for _ in range(recursions.REGIME_ROUNDS):
        (m0, v0), (m1, v1) = [((k * y).sum() / k.sum(), max(floor, (k * (y - (k * y).sum() / k.sum()) ** 2).sum() / k.sum()))
                              for k in (1 - high, high)]
        pred, filt, p = [], [], start
        for x in y:
            low = np.exp(-0.5 * (x - m0) ** 2 / v0) / v0 ** 0.5
            up = np.exp(-0.5 * (x - m1) ** 2 / v1) / v1 ** 0.5
            pred.append(p)
            filt.append(p * up / (p * up + (1 - p) * low))
            p = a + (b - a) * filt[-1]
        smooth, rose, fell = [filt[-1]], 0.0, 0.0
        for k in range(len(y) - 2, -1, -1):
            above, below = smooth[0] / pred[k + 1], (1 - smooth[0]) / (1 - pred[k + 1])
            rose += a * above * (1 - filt[k])
            fell += (1 - b) * below * filt[k]
            smooth.insert(0, filt[k] * (b * above + (1 - b) * below))
        high = np.array(smooth)
        n = high[:-1].sum()
        a, b, start = clip(rose / (len(y) - 1 - n)), clip(1 - fell / n), clip(high[0])
    (m0, m1), p, out = [(k * y).sum() / k.sum() for k in (1 - high, high)], high[-1], []
    for _ in range(h):
        p = a + (b - a) * p
        out.append((1 - p) * m0 + p * m1)
    return out


def test_regimes_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(8)
    rows = [np.where(rng.random(n) < 0.5, 10, 40) + rng.normal(0, 3, n) for n in (12, 25, 40)]
    for y, got in zip(rows, fitted(spark, recursions.markov, rows, 4)):
        assert got.valores == pytest.approx(markov_fit(y, 4), rel=1e-6)


def test_zero_fill_and_company_filter(movimentos):
    df = movimentos([mov(1, "A", 100, 0), mov(2, "B", -40, 2), mov(3, "A", 20, 4), mov(4, "A, LDA", 20, 6)])
    cf = series.cashflow_series(df)
    rows = {r.t: r for r in cf.where("serie = '*'").collect()}
    assert sorted(rows) == list(range(7))
    assert (rows[1].recebimentos, rows[1].pagamentos, rows[1].liquido) == (0, 0, 0)
    assert (rows[2].pagamentos, rows[2].liquido) == (40, -40)
    a = {r.t: float(r.liquido) for r in cf.where("serie = 'A'").collect()}
    assert a == {0: 100, 1: 0, 2: 0, 3: 0, 4: 20, 5: 0, 6: 20}


def test_one_company(movimentos, saldos):
    df = movimentos([mov(i, "Ancora Apogeu", 10, i) for i in range(12)] + [mov(50 + i, "B", 999, i) for i in range(12)])
    out = forecast.cashflow(df, 2, empresa="ANCORA APOGEU,LDA").collect()
    assert {r.serie for r in out} == {"ANCORAAPOGEU"}
    assert all(r.valor == pytest.approx(10, abs=1e-6) for r in out)
    scores = forecast.evaluate_cashflow(df, 5, empresa="Ancora Apogeu").where("rmse is not null").collect()
    assert scores and all(r.rmse == pytest.approx(0, abs=1e-6) for r in scores)
    bs = saldos([dict(id=i, dia=D0 + timedelta(days=i), entidade="Ancora Apogeu", saldo_contabilistico=50)
                 for i in range(6)])
    assert forecast.balance(bs, 3, "ANCORA APOGEU,LDA").select("dia").distinct().count() == 3
    assert forecast.balance(bs, 3, "Outra").count() == 0
    assert forecast.evaluate_balance(bs, 1).where("rmse is not null").count() >= 3


def test_boosting_learns_the_week(spark):
    df = long(spark, {"*": week(20), "curta": [50.0] * 6})
    out = forecast.forecast(df, 4, boosting=True).collect()
    ahead = [r.valor for r in sorted(out, key=lambda r: r.dia) if r.modelo == "gradient_boosting"]
    want = week(24)[20:]
    assert ahead == pytest.approx(want, abs=20)
    assert {r.modelo for r in out if r.serie == "curta"} >= {"regressao_linear", "media_movel"}
    assert not [r for r in out if r.serie == "curta" and r.modelo == "gradient_boosting"]
    shares = forecast.feature_importance(df).collect()
    assert len(shares) == 7 and sum(r.importancia for r in shares) == pytest.approx(1)
    assert all(r.nome != r.feature for r in shares)


def test_boosting_holdout_needs_fifteen_training_days(spark):
    df = long(spark, {"longa": week(25), "curta": week(19)})
    scores = {(r.serie, r.modelo): r for r in forecast.backtest(df, 5, boosting=True).collect()}
    assert scores["longa", "gradient_boosting"].rmse is not None
    assert scores["curta", "gradient_boosting"].falha == "só há 14 pontos e são precisos 15"


def test_steps_ahead_use_the_features_of_the_table(spark):
    """The row that is predicted from is the one the features table would have."""
    values = [float(v) for v in np.random.default_rng(0).normal(0, 10, 41)]
    df = long(spark, {"a": values[:40], "b": week(40)})
    rows = boosting.scaled(forecast.gather(df)).cache()
    model = boosting.fit(rows)
    got = {r.serie: r.valores for r in boosting.ahead(rows, model, 2).collect()}
    scale = rows.where("serie = 'a'").first()
    units = [(v - scale.centro) / scale.desvio for v in values]
    last = series.features(long(spark, {"a": units})).where("t = 40")
    want = model.transform(boosting._assembler().transform(last)).first().prediction
    assert got["a"][0] == pytest.approx(scale.centro + scale.desvio * want)
    assert len(got["a"]) == 2 and got["b"] == pytest.approx(week(42)[40:], abs=20)


def test_chart(spark):
    df = long(spark, {"a": [1.0] * 6})
    rows = forecast.chart_series(df, forecast.forecast_simple(df, 2)).collect()
    assert {r.tipo_linha for r in rows} == {"Histórico", "Previsão"}
    assert {r.nome for r in rows} == {"Histórico", "Regressão linear", "Média móvel"}


def test_row_and_column_forms_of_the_simple_models_agree(spark):
    rng = np.random.default_rng(4)
    df = long(spark, {f"s{i}": rng.normal(0, 50, 6 + i).cumsum() for i in range(6)})
    columns = {(r.serie, r.modelo, r.dia): r.valor for r in forecast.forecast_simple(df, 4).collect()}
    rows = {(r.serie, r.modelo, r.dia): r.valor for r in forecast.forecast(df, 4).collect()}
    assert columns == {k: pytest.approx(rows[k]) for k in columns}
