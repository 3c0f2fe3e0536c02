"""SQL of the recursive forecasts: a table of states per day, one recursion per grid."""

from __future__ import annotations

_NUMBER = "cast({0} as double)"
# what the state of a fold becomes with the value y of the next day, by model
_HOLT_NEXT = {
    "f": "s.f + s.b + s.k * (y - s.f)", "b": "s.b + s.j * (y - s.f)",
    "f1": "s.f1 + s.b1 - s.k * s.f1", "b1": "s.b1 - s.j * s.f1",
    "f2": "s.f2 + s.b2 - s.k * s.f2", "b2": "s.b2 - s.j * s.f2",
    "s0": "s.s0 + (y - s.f) * (y - s.f)", "v1": "s.v1 - (y - s.f) * s.f1", "v2": "s.v2 - (y - s.f) * s.f2",
    "m11": "s.m11 + s.f1 * s.f1", "m12": "s.m12 + s.f1 * s.f2", "m22": "s.m22 + s.f2 * s.f2"}
_HOLT_BEGIN = {"f": 0, "b": 0, "f1": 1, "b1": 0, "f2": 1, "b2": 1, "s0": 0, "v1": 0, "v2": 0, "m11": 0, "m12": 0, "m22": 0}
_ARIMA_NEXT = {
    "a": "y - s.p * z - s.q * s.a", "c": "s.p - 1 - s.q * s.c", "aa": "s.aa + s.a * s.a",
    "ac": "s.ac + s.a * s.c", "cc": "s.cc + s.c * s.c"}
_ARIMA_BEGIN = {"a": 0, "c": 0, "aa": 0, "ac": 0, "cc": 0}


def _recursion(name: str, grid: str, own: list[str], begin: dict, after: dict, first: int) -> str:
    """``name`` has the last state of each series and grid point; ``grid`` the columns serie, n, own."""
    keys = ", ".join(["serie", "n", *own])
    start = ", ".join(f"{_NUMBER.format(v)} {k}" for k, v in begin.items())
    step = ", ".join(after.values())
    return f"""
{name}_s(t, {keys}, {', '.join(begin)}) as (
  select {first}, {keys}, {start} from {grid}
  union all
  select s.t + 1, s.serie, s.n, {', '.join('s.' + c for c in own)}, {step}
  from {name}_s s join dias d on d.serie = s.serie and d.t = s.t),
{name} as (select s.* from {name}_s s join fim on fim.serie = s.serie and fim.u + 1 = s.t)"""


def _holt_round(number: int, points: str) -> str:
    grid, run = f"g{number}", f"r{number}"
    return f"""
{grid} as (select serie, n, al, be, al + al * be k, al * be j from ({points})),{_recursion(run, grid, ["al", "be", "k", "j"], _HOLT_BEGIN, _HOLT_NEXT, 0)},
x{number} as (
  select *, (v2 * m12 - v1 * (m22 + e)) / ((m11 + e) * (m22 + e) - m12 * m12) x1,
    (v1 * m12 - v2 * (m11 + e)) / ((m11 + e) * (m22 + e) - m12 * m12) x2 from {run}, (select cast(1e-9 as double) e)),
u{number} as (
  select * from x{number}
  qualify row_number() over (partition by serie order by s0 + x1 * v1 + x2 * v2, n) = 1)"""


def _beside(best: str, columns: tuple[str, str], step: float, low: float, high: float, offsets: list[int]) -> str:
    """Points around the best one, in the order of the offsets."""
    one, two = columns
    places = ", ".join(f"({k}, {o})" for k, o in enumerate(offsets))
    near = (f"greatest({_NUMBER.format(low)}, least({_NUMBER.format(high)}, "
            f"{{0}} + {_NUMBER.format(step)} * cast({{1}} as double)))")
    return (f"select serie, i.k * {len(offsets)} + j.k n, {near.format(one, 'i.o')} {one}, {near.format(two, 'j.o')} {two} "
            f"from {best}, (values {places}) i(k, o), (values {places}) j(k, o)")


def holt(series: str) -> str:
    """``series`` are CTEs with a table usavel(serie, t, dia, valor)."""
    first = (f"select serie, i * 6 + j n, {_NUMBER.format(0.05)} + {_NUMBER.format(0.18)} * i al, "
             f"{_NUMBER.format(0.05)} + {_NUMBER.format(0.18)} * j be from fim, range(6) x(i), range(6) y(j)")
    rounds = [_holt_round(0, first)]
    for k, step in enumerate((0.09, 0.045, 0.0225)):
        rounds.append(_holt_round(k + 1, _beside(f"u{k}", ("al", "be"), step, 0.01, 0.99, [0, -1, 1])))
    return f"""with recursive {series},
fim as (select serie, max(t) u, max(dia) fim from usavel group by serie),
dias as (select serie, t, valor y from usavel),{','.join(rounds)},
e_s(t, serie, k, j, f, b) as (
  select 0, serie, k, j, x1 + x2, x2 from u3
  union all
  select s.t + 1, s.serie, s.k, s.j, s.f + s.b + s.k * (y - s.f), s.b + s.j * (y - s.f)
  from e_s s join dias d on d.serie = s.serie and d.t = s.t)
select serie, cast(cast(fim + cast(i + 1 as integer) as date) as varchar) dia, round(f + b * i, 4) valor
from e_s join fim using (serie), range(7) h(i) where e_s.t = u + 1"""


def _arima_round(number: int, points: str) -> str:
    return f"""
g{number} as ({points}),{_recursion(f"r{number}", f"g{number}", ["p", "q"], _ARIMA_BEGIN, _ARIMA_NEXT, 2)},
x{number} as (
  select *, -(ac + a * c) / (cc + c * c) d, aa + a * a - (ac + a * c) / (cc + c * c) * (ac + a * c) erro from r{number}),
u{number} as (
  select * from (select x.*, min(erro) over (partition by serie) + folga pior from x{number} x join folgas using (serie))
  qualify n = min(case when erro <= pior then n end) over (partition by serie))"""


def arima(series: str) -> str:
    offsets = [0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6]
    places = ", ".join(f"({k}, {o})" for k, o in enumerate(offsets))
    first = (f"select serie, i.k * 13 + j.k n, {_NUMBER.format(0.15)} * i.o p, {_NUMBER.format(0.15)} * j.o q "
             f"from fim, (values {places}) i(k, o), (values {places}) j(k, o)")
    rounds = [_arima_round(0, first)]
    for k, step in enumerate((0.05, 0.0125)):
        rounds.append(_arima_round(k + 1, _beside(f"u{k}", ("p", "q"), step, -0.99, 0.99, [0, -1, 1, -2, 2])))
    return f"""with recursive {series},
fim as (select serie, max(t) u, max(dia) fim from usavel group by serie),
passos_w as (
  select serie, t, valor, valor - lag(valor) over (partition by serie order by t) y from usavel),
dias as (select serie, t, y, lag(y) over (partition by serie order by t) z from passos_w),
folgas as (
  select serie, cast(1e-10 as double) * list_reduce(list(q order by t), lambda a, x: a + x) folga
  from (select serie, t, y * y q from dias where t >= 2) group by serie),{','.join(rounds)},
h_s(i, serie, p, d, v, x) as (
  select 0, u2.serie, p, d, l.valor, d + p * (l.y - d) + q * (a + c * d)
  from u2 join fim on fim.serie = u2.serie join passos_w l on l.serie = u2.serie and l.t = fim.u
  union all
  select i + 1, serie, p, d, v + x, d + p * (x - d) from h_s where i < 7)
select serie, cast(cast(fim + cast(i as integer) as date) as varchar) dia, round(v, 4) valor
from h_s join fim using (serie) where i > 0"""
