"""The isolation forest as SQL: the trees of ``operators.anomaly`` grown node by node.

Every level picks the first gap of each of its nodes by a window; the draws and waiting times
come from the same digests as the operator's. Needs ``fluxos``.
"""

from __future__ import annotations

from bankrec.operators.anomaly import EULER, MIN_HISTORY, ONE, PRIME, SEED, TREE_ROWS, TREES, multipliers


def _start(text: str) -> str:
    return f"(1 + ('0x' || substr(md5(concat_ws('/', '{SEED}', {text})), 1, 15))::bigint % {PRIME - 1})"


def _path_length(m: str) -> str:
    return (f"case when {m} > 2 then 2 * (ln({m} - 1) + {EULER}::double) - 2.0::double * ({m} - 1) / {m} "
            f"when {m} = 2 then 1.0::double else 0.0::double end")


_TREES = ", ".join(str((t, *steps)) for t, steps in enumerate(zip(*(multipliers(kind) for kind in range(3)))))

FOREST = f"""
arvore(t, m0, m1, m2) as (values {_TREES}),
conhecida as (select empresa, count(*) n from fluxos where valor is not null group by empresa having count(*) >= {MIN_HISTORY}),
quantia as (
  select id, empresa, cast(valor * 100 as bigint) v, {_start('id')} h
  from fluxos join conhecida using (empresa) where valor is not null),
tirada as (
  select empresa, t, m1, m2, v, count(*) c from (
    select *, row_number() over (partition by empresa, t order by (h * m0) % {PRIME}, id) r from quantia, arvore)
  where r <= {TREE_ROWS} group by all),
ponto as (
  select *, row_number() over w j, lead(v) over w seguinte, sum(c) over w ate,
    sum(c) over (partition by empresa, t) n, count(*) over (partition by empresa, t) k, {_start('empresa, v')} g
  from tirada window w as (partition by empresa, t order by v)),
lacuna as (
  select *, -ln(((g * m1) % {PRIME}) / {PRIME}::double) / (seguinte - v) e, ceil(log2(greatest(n, 2))) fundo,
    v + cast(floor((seguinte - v) * (((g * m2) % {PRIME}) / {PRIME}::double)) as bigint) corte
  from ponto where seguinte is not null),
nivel as (
  select empresa, t, j, e, fundo, corte, ate, 0 prof, cast(1 as bigint) no,
    first_value(j) over (partition by empresa, t order by e, j) primeiro from lacuna
  union all
  select empresa, t, j, e, fundo, corte, ate, prof, no, first_value(j) over (partition by empresa, t, no order by e, j) from (
    select * exclude (prof, no, primeiro), prof + 1 prof, 2 * no + case when j > primeiro then 1 else 0 end no
    from nivel where j <> primeiro and prof + 1 < fundo)),
limite_de_folha as (
  select empresa, t, j, prof, ate, corte from nivel where j = primeiro
  union all select distinct empresa, t, 0, -1, 0, cast({-(1 << 63)} as bigint) from ponto),
folha as (
  select empresa, t, corte, j, 1 + greatest(prof, lead(prof, 1, -1) over w) prof,
    coalesce(lead(ate) over w, n) - ate m
  from limite_de_folha join (select distinct empresa, t, n from ponto) using (empresa, t)
  window w as (partition by empresa, t order by j)),
alta as (select *, prof * {ONE} + cast(round({ONE} * ({_path_length('m')})) as bigint) alt from folha),
degrau as (
  select empresa, corte, sum(sobe) sobe from (
    select *, alt - lag(alt, 1, 0) over (partition by empresa, t order by j) sobe from alta) group by all),
floresta as (
  select empresa, corte, altura, -pow(2, -(altura / ({ONE * TREES}::double) / greatest({_path_length('n')}, 1e-9::double))) nota
  from (select empresa, corte, cast(sum(sobe) over (partition by empresa order by corte) as bigint) altura from degrau)
  join (select empresa, max(n) n from ponto group by empresa) using (empresa)),
pontuada as (
  select q.id, q.empresa, f.altura, f.nota from quantia q asof join floresta f on q.empresa = f.empresa and f.corte < q.v),
limiar as (select empresa, quantile_cont(altura, 0.1) limite from pontuada group by empresa)"""
