"""Recursive models of short series as folds over the series' array, for many series at a time.

Each model is a SQL expression over an array column that makes ``struct<falha, valores>``: the
next ``h`` values, or the reason there are none. A grid of parameters is tried by one fold each;
what enters linearly (start values, drift) is solved exactly from sums that the same fold
collects. Finer grids around the best follow. A step of a fold is taken for all series of a batch
and all points of their grids at once, in numpy; nothing leaves the row, so nothing is shuffled.

Values of a batch are a matrix, days down and series across, longest series first, so the
series that a step has to do with are always the first ``m`` columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HOLT = "suavizacao_exponencial"
ARIMA = "arima"
MARKOV = "markov_switching"
MIN_ARIMA = 4
REGIME_ROUNDS = 25       # of expectation and maximisation
_BESIDE, _NEAR = [0, -1, 1], [0, -1, 1, -2, 2]
_STATES = 1 << 15        # folds that run side by side
_RESULT = "falha string, valores array<double>"
NOT_FINITE = "previsão não finita"

Model = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _batch(series: pd.Series, model: Model, h: int, width: int) -> pd.DataFrame:
    """``model`` for ``width`` series at a time, which are as long as their neighbours."""
    size = np.array([0 if v is None else len(v) for v in series], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    values, failures = np.empty((len(size), h)), np.empty(len(size), dtype=object)
    for first in range(0, len(order), width):
        own = order[first:first + width]
        n = size[own]
        y = np.zeros((max(1, n[0]), len(own)))
        for column, at in enumerate(own):
            y[:n[column], column] = series.iat[at] if n[column] else 0.0
        with np.errstate(all="ignore"):
            values[own], failures[own] = model(y, n, h)
    wrong = np.array([f is None for f in failures], dtype=bool) & ~np.isfinite(values).all(axis=1)
    failures[wrong] = NOT_FINITE
    return pd.DataFrame({"falha": failures, "valores": [v if f is None else None for v, f in zip(values, failures)]})


def _sql(name: str, model: Model, width: int, values: str, h: int) -> str:
    """A call of the model as a function of the session."""
    def fold(series: pd.Series) -> pd.DataFrame:
        return _batch(series, model, h, width)

    function = f"bankrec_{name}_{h}"
    SparkSession.active().udf.register(function, F.pandas_udf(fold, _RESULT))
    return f"{function}({values})"


def _active(n: np.ndarray, steps: int) -> list[int]:
    """How many series have a value at each step."""
    return (n[None, :] > np.arange(steps)[:, None]).sum(axis=1).tolist()


def _grid(first, second) -> tuple[np.ndarray, np.ndarray]:
    """All pairs, the second running faster."""
    return np.repeat(np.asarray(first, float), len(second))[None, :], np.tile(np.asarray(second, float), len(first))[None, :]


def _around(first: np.ndarray, second: np.ndarray, sides: list[int], step: float, low: float) -> tuple[np.ndarray, np.ndarray]:
    """A finer grid around each series' pair, inside the bounds."""
    i, j = _grid(sides, sides)
    return tuple(np.maximum(low, np.fmin(0.99, at[:, None] + step * side)) for at, side in ((first, i), (second, j)))


def _pick(at: np.ndarray, *grids: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.take_along_axis(g, at[:, None], axis=1)[:, 0] for g in grids)


# ---- level and trend -------------------------------------------------------

def _holt_best(y: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a grid of (a, b) the smallest squared error, with the best start level and trend."""
    shape = (y.shape[1], a.shape[1])
    a, b = np.broadcast_to(a, shape), np.broadcast_to(b, shape)
    k, j = a + a * b, a * b
    # f is what is expected next, c the trend; f1, c1 and f2, c2 what a unit of start level and
    # of start trend add to them
    f, c, c1, s, v1, v2, m11, m12, m22 = (np.zeros(shape) for _ in range(9))
    f1, f2, c2 = (np.ones(shape) for _ in range(3))
    for t, m in enumerate(_active(n, len(y))):
        now = slice(0, m)
        kt, jt, g1, g2 = k[now], j[now], f1[now], f2[now]
        e = y[t, now, None] - f[now]
        s[now] += e * e
        v1[now] -= e * g1
        v2[now] -= e * g2
        m11[now] += g1 * g1
        m12[now] += g1 * g2
        m22[now] += g2 * g2
        f[now] = f[now] + c[now] + kt * e
        c[now] += jt * e
        f1[now], c1[now] = g1 + c1[now] - kt * g1, c1[now] - jt * g1
        f2[now], c2[now] = g2 + c2[now] - kt * g2, c2[now] - jt * g2
    p11, p22 = m11 + 1e-9, m22 + 1e-9
    x1, x2 = (v2 * m12 - v1 * p22) / (p11 * p22 - m12 * m12), (v1 * m12 - v2 * p11) / (p11 * p22 - m12 * m12)
    error = s + x1 * v1 + x2 * v2
    return _pick(np.argmin(np.where(np.isnan(error), np.inf, error), axis=1), a, b, k, j, x1, x2)


def _holt(y: np.ndarray, n: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    steps = 0.05 + 0.18 * np.arange(6)
    best = _holt_best(y, n, *_grid(steps, steps))
    for step in (0.09, 0.045, 0.0225):
        best = _holt_best(y, n, *_around(best[0], best[1], _BESIDE, step, 0.01))
    _, _, k, j, x1, x2 = best
    f, c = x1 + x2, x2.copy()
    for t, m in enumerate(_active(n, len(y))):
        e = y[t, :m] - f[:m]
        f[:m] = f[:m] + c[:m] + k[:m] * e
        c[:m] += j[:m] * e
    return f[:, None] + c[:, None] * np.arange(h), np.full(len(n), None)


def holt(values: str, h: int) -> str:
    """Exponential smoothing of level and trend."""
    return _sql("holt", _holt, _STATES // 36, values, h)


# ---- ARIMA(1,1,1) with drift -----------------------------------------------

def _arima_best(d: np.ndarray, active: list[int], slack: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first point of the grid that is as good as the best, but for rounding."""
    shape = (d.shape[1], p.shape[1])
    p, q = np.broadcast_to(p, shape), np.broadcast_to(q, shape)
    # the error is a + c * drift; sums lag one step behind, the first errors are zero
    a, c, aa, ac, cc = (np.zeros(shape) for _ in range(5))
    for t, m in enumerate(active):
        now = slice(0, m)
        at, ct, pt, qt = a[now], c[now], p[now], q[now]
        aa[now] += at * at
        ac[now] += at * ct
        cc[now] += ct * ct
        a[now], c[now] = d[t + 1, now, None] - pt * d[t, now, None] - qt * at, pt - 1.0 - qt * ct
    aa, ac, cc = aa + a * a, ac + a * c, cc + c * c
    error = aa - ac / cc * ac
    enough = np.fmin.reduce(error, axis=1) + slack
    return _pick(np.argmax(error <= enough[:, None], axis=1), p, q, -ac / cc, a, c)


def _arima(y: np.ndarray, n: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    columns = np.arange(len(n))
    d = np.diff(y, axis=0)
    active = _active(np.maximum(n - 2, 0), max(len(d) - 1, 0))
    slack = np.zeros(len(n))
    for t, m in enumerate(active):
        slack[:m] += d[t + 1, :m] * d[t + 1, :m]
    slack *= 1e-10
    side = 0.15 * np.array([0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6])
    best = _arima_best(d, active, slack, *_grid(side, side))
    for step in (0.05, 0.0125):
        best = _arima_best(d, active, slack, *_around(best[0], best[1], _NEAR, step, -0.99))
    p, q, drift, a, c = best
    values, out = y[np.maximum(n - 1, 0), columns], np.empty((len(n), h))
    last = d[np.maximum(n - 2, 0), columns] if len(d) else np.zeros(len(n))
    x = drift + p * (last - drift) + q * (a + c * drift)
    for i in range(h):
        values = values + x
        out[:, i] = values
        x = drift + p * (x - drift)
    return out, np.where(n < MIN_ARIMA, "série demasiado curta", None)


def arima(values: str, h: int) -> str:
    """Differences follow their predecessor and the last error; small parameters come first."""
    return _sql("arima", _arima, _STATES // 169, values, h)


# ---- two regimes -----------------------------------------------------------

def _inside(p: np.ndarray) -> np.ndarray:
    return np.maximum(1e-12, np.fmin(1 - 1e-12, p))


def _moments(y: np.ndarray, weight: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and variance of the values in one regime."""
    total = np.maximum(1e-300, weight.sum(axis=0))
    mean = (weight * y).sum(axis=0) / total
    return mean, np.maximum(floor, (weight * (y - mean) * (y - mean)).sum(axis=0) / total)


def _markov(y: np.ndarray, n: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    days, columns = np.arange(len(y))[:, None], np.arange(len(n))
    there, before_last = (days < n).astype(float), (days < n - 1).astype(float)
    active, end = _active(n, len(y)), np.maximum(n - 1, 0)
    mean = y.sum(axis=0) / n
    spread = (there * (y - mean) * (y - mean)).sum(axis=0) / n
    floor = 1e-8 * spread
    ordered = np.sort(np.where(there > 0, y, np.inf), axis=0)
    middle = (ordered[end // 2, columns] + ordered[n // 2, columns]) / 2
    high = there * (y > middle)
    high = np.where(high.any(axis=0), high, 0.5 * there)
    a, b, begin = np.full(len(n), 0.1), np.full(len(n), 0.9), np.full(len(n), 0.5)
    filtered, expected, smooth = np.zeros_like(y), np.full_like(y, 0.5), np.zeros_like(y)
    for _ in range(REGIME_ROUNDS):
        (m0, v0), (m1, v1) = _moments(y, there * (1 - high), floor), _moments(y, high, floor)
        odds = np.exp(-0.5 * (np.log(v0) + (y - m0) * (y - m0) / v0 - np.log(v1) - (y - m1) * (y - m1) / v1))
        p = begin.copy()
        for t, m in enumerate(active):
            expected[t, :m] = p[:m]
            filtered[t, :m] = 1 / (1 + (1 - p[:m]) / p[:m] * odds[t, :m])
            p[:m] = a[:m] + (b[:m] - a[:m]) * filtered[t, :m]
        s, rose, fell = filtered[end, columns], np.zeros(len(n)), np.zeros(len(n))
        smooth[end, columns] = s
        for t in range(len(y) - 2, -1, -1):
            m = active[t + 1]
            up, down, now = s[:m] / expected[t + 1, :m], (1 - s[:m]) / (1 - expected[t + 1, :m]), filtered[t, :m]
            rose[:m] += a[:m] * up * (1 - now)
            fell[:m] += (1 - b[:m]) * down * now
            s[:m] = now * (b[:m] * up + (1 - b[:m]) * down)
            smooth[t, :m] = s[:m]
        high = there * smooth
        stayed = (before_last * smooth).sum(axis=0)
        a, b = _inside(rose / np.maximum(1e-300, n - 1 - stayed)), _inside(1 - fell / np.maximum(1e-300, stayed))
        begin = _inside(smooth[0])
    (m0, _), (m1, _) = _moments(y, there * (1 - high), floor), _moments(y, high, floor)
    weight, p, out = high.sum(axis=0), high[end, columns], np.empty((len(n), h))
    for i in range(h):
        p = a + (b - a) * p
        out[:, i] = (1 - p) * m0 + p * m1
    failure = np.where(np.fmin(weight, n - weight) < 1, "um dos regimes ficou sem pontos", None)
    return out, np.where(~(spread > 0) & ~np.isnan(spread), "variância nula", failure)


def markov(values: str, h: int) -> str:
    """A mean and a variance in each of two regimes, and the chance to be in the high one next
    from either; a fixed number of filter and smoother rounds."""
    return _sql("markov", _markov, 1024, values, h)
