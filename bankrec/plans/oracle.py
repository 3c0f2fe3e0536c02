"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from bankrec.plans import forest_sql, recursive_sql

_KEY = """regexp_replace(array_to_string(list_filter(
    regexp_split_to_array(upper(strip_accents(trim({0}))), '[\\s,]+'),
    lambda x: regexp_replace(x, '[^A-Z0-9]', '', 'g') not in ('LDA','SA','DE','DA','DO','E')), ' '),
    '[^A-Z0-9]', '', 'g')"""

_LEDGER = f"""
ordens as (
  select o_orderkey k, cast(o_orderdate as date) dia, c_name, o_orderpriority,
    cast(case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as decimal(18,2)) v
  from orders join customer on o_custkey = c_custkey),
movimentos as (
  select *, {_KEY.format('empresa')} chave from (
    select 2*k id, dia, upper(c_name) || ',LDA' empresa, o_orderpriority descricao, v valor
    from ordens where k % 10 <> 9
    union all
    select 2*k+1, dia, c_name, o_orderpriority, v from ordens where k % 10 <> 9 and k % 17 = 0)),
linhas as (
  select *, {_KEY.format('empresa')} chave from (
    select 2*k id, dia, c_name empresa, v previsto, case when k % 13 = 0 then v end pago,
      5 + k % 40 linha, case when v >= 0 then 'recebimento' else 'pagamento' end tipo,
      'IMP' || (k % 5) imputacao
    from ordens where k % 7 <> 6
    union all
    select 2*k+1, dia, c_name || ' SA', v, null, 5 + k % 40,
      case when v >= 0 then 'recebimento' else 'pagamento' end, 'IMP' || (k % 5)
    from ordens where k % 7 <> 6 and k % 11 = 0)),
abertas as (
  select dia, chave, previsto valor, count(*) n, min(id) linha_id,
    string_agg(cast(id as varchar), ',' order by id) ids
  from linhas where pago is null and previsto is not null group by all)"""

_RUN = _LEDGER + """,
numerados as (
  select m.*, row_number() over (partition by dia, chave, valor order by id) rn,
    min(id) over (partition by dia, chave, valor) primeiro from movimentos m),
estado as (
  select r.*, coalesce(a.n, 0) n, ids,
    case when coalesce(a.n, 0) = 0 then 'novo' when a.n >= 2 then 'ambiguo'
         when rn = 1 then 'exato' else 'novo' end tipo_match,
    case when a.n = 1 and rn = 1 then a.linha_id end linha_id, a.linha_id menor
  from numerados r left join abertas a using (dia, chave, valor)),
linhas_depois as (
  select l.* replace (coalesce(l.pago, e.valor) as pago)
  from linhas l left join estado e on e.linha_id = l.id)"""

_FLOWS = f"""
fluxos as (
  select event_id id, cast(ts as date) dia, empresa, event_type descricao, valor,
    {_KEY.format('empresa')} chave
  from (select *, 'Conta ' || user_id || ', SA' empresa,
    cast(case when event_type in ('error','view') then -value else value end as decimal(18,2)) valor
    from events)),
diario as (select empresa entidade, chave, dia, sum(valor) v, min(id) id from fluxos group by all),
saldos as (
  select id, dia, entidade, chave, c saldo_contabilistico,
    cast(c * cast(0.9 as decimal(18,2)) as decimal(18,2)) saldo_disponivel
  from (select *, cast(sum(v) over (partition by entidade order by dia) as decimal(18,2)) c from diario)),
resumo as (
  select dia, coalesce(sum(valor) filter (valor >= 0), 0) recebimentos,
    coalesce(sum(-valor) filter (valor < 0), 0) pagamentos from fluxos group by dia)"""

_SERIES = _FLOWS + """,
por_serie as (
  select unnest([chave, '*']) serie, dia, valor from fluxos),
limites as (select serie, min(dia) de, max(dia) ate from por_serie group by serie),
grelha as (select serie, cast(unnest(generate_series(de, ate, interval 1 day)) as date) dia, de from limites),
serie as (
  select g.serie, g.dia, date_diff('day', g.de, g.dia) t,
    coalesce(sum(valor) filter (valor >= 0), 0) recebimentos,
    coalesce(sum(-valor) filter (valor < 0), 0) pagamentos,
    cast(coalesce(sum(valor), 0) as double) valor
  from grelha g left join por_serie p on p.serie = g.serie and p.dia = g.dia group by all),
usavel as (select * from serie qualify count(*) over (partition by serie) >= 5),
reta as (
  select serie, regr_slope(valor, t) m, regr_intercept(valor, t) b, max(t) u, max(dia) fim
  from usavel group by serie),
media as (
  select serie, avg(valor) v, max(dia) fim from (
    select *, row_number() over (partition by serie order by t desc) r from usavel) where r <= 5
  group by serie),
passos as (select unnest(range(1, 8)) p),
previsto as (
  select serie, 'regressao_linear' modelo, cast(fim + cast(p as integer) as date) dia, b + m*(u+p) valor
  from reta, passos
  union all
  select serie, 'media_movel', cast(fim + cast(p as integer) as date), v from media, passos)"""

_BACKTEST = _SERIES + """,
medidas as (select *, count(*) over (partition by serie) n from serie qualify n >= 10),
treino as (select * from medidas where t < n - 5),
teste as (select * from medidas where t >= n - 5),
ajuste as (select serie, regr_slope(valor, t) m, regr_intercept(valor, t) b from treino group by serie),
nivel as (select serie, avg(valor) v from treino where t >= n - 10 group by serie),
erros as (
  select serie, 'regressao_linear' modelo, 1 ordem, sqrt(avg(power(valor - (b + m*t), 2))) rmse
  from teste join ajuste using (serie) group by serie
  union all
  select serie, 'media_movel', 2, sqrt(avg(power(valor - v, 2)))
  from teste join nivel using (serie) group by serie)"""

_RUNS = """
execucoes as (
  select event_id id, event_type script, case when value > 200 then 'erro' else 'ok' end status,
    case when value > 200 then 'valor ' || cast(cast(value as decimal(18,2)) as varchar) || ' acima do limite' end erro,
    props, ts from events),
-- fixed values: the known scripts
conhecidos(nome, descricao, hora_execucao) as (values
  ('preencher_mapa', 'Preenchimento do Mapa de Pagamentos e Recebimentos a partir dos extratos bancários',
   '08:50, 12:50, 14:10, 16:15, 18:30'),
  ('atualizar_mapa_saldos', 'Atualização do Mapa de Saldos Bancários (folhas diárias)',
   '08:55, 12:55, 14:15, 16:20, 18:35'),
  ('enviar_mapa_smtp', 'Envio diário do Mapa de Pagamentos e Recebimentos por email', '16:30')),
nomes as (select nome from conhecidos union select script from execucoes),
scripts as (
  select nome, coalesce(descricao, 'Script ' || nome) descricao, coalesce(hora_execucao, '08:00') hora_execucao
  from nomes left join conhecidos using (nome)),
ultimas as (
  select script nome, arg_max(status, (ts, id)) status, arg_max({'e': erro}, (ts, id)).e erro, max(ts) ts
  from execucoes group by script),
devidas as (
  select nome, max(timestamp '2024-01-30 00:00:00' + h) devida from (
    select nome, cast(trim(unnest(string_split(hora_execucao, ','))) as interval) h from scripts)
  where timestamp '2024-01-30 00:00:00' + h <= timestamp '2024-01-30 12:55:00' group by nome),
situacao as (
  select s.*, coalesce(u.status, 'ok') status, u.erro ultima_erro,
    strftime(u.ts, '%Y-%m-%dT%H:%M:%SZ') ultima_execucao,
    d.devida is not null and (u.ts is null or date_trunc('second', u.ts) < d.devida) atrasado,
    case when d.devida is not null and (u.ts is null or date_trunc('second', u.ts) < d.devida)
         then strftime(d.devida, '%H:%M') end hora_em_falta
  from scripts s left join ultimas u using (nome) left join devidas d using (nome)),
registos as (
  select id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, script,
    case when status = 'erro' then 'erro' else 'info' end nivel,
    coalesce(nullif(erro, ''), 'Execução do script ' || script || ' registada com status ' || status || '.') mensagem,
    props detalhe from execucoes)"""

_CASES = _RUN + """,
casos as (
  select id, dia, chave, empresa, valor, descricao, n, ids, menor, primeiro,
    case when id % 3 <> 0 then 'linha_id=' || menor end resolucao
  from estado where tipo_match = 'ambiguo')"""

# the pages of the candidates of all groups, or of those with an open case
_PAGES = _CASES + """,
grupos as (select distinct dia, chave, valor, primeiro grupo, n, bool_or(resolucao is null) over (partition by primeiro) aberto from casos),
candidatas as (
  select grupo, aberto, (l.id % 2147483647 * 16807 % 2147483647) % cast(ceil(n / 1000.0) as bigint) pagina, l.*
  from grupos g join linhas l on l.dia = g.dia and l.chave = g.chave and l.previsto = g.valor and l.pago is null)"""

_DAY = "cast(dia as varchar) dia"


def _sql(body: str, prefix: str = "") -> str:
    return f"with {prefix} {body}" if prefix else body


ORACLE: dict[str, str] = {
    "company_keys": _sql(
        "select distinct empresa, strip_accents(empresa) sem_acentos, chave from movimentos", _LEDGER),
    "money_parse": _sql(
        "select id, case when id % 7 <> 0 then cast(valor as double) end valor, "
        "cast(valor as double) valor_estrito from movimentos", _LEDGER),
    "reconcile_status": _sql("select id, tipo_match, linha_id from estado", _RUN),
    "reconcile_summary": _sql(
        f"select {_DAY}, count(*) filter (tipo_match = 'exato') casados, "
        "count(*) filter (tipo_match = 'novo') novos, count(*) filter (tipo_match = 'ambiguo') ambiguos "
        "from estado group by all", _RUN),
    "reconcile_rerun": _sql(
        "select r.id, case when coalesce(n, 0) = 0 then 'novo' when n >= 2 then 'ambiguo' "
        "when rn = 1 then 'exato' else 'novo' end tipo_match from ("
        "select *, row_number() over (partition by dia, chave, valor order by (id % 3 <> 0), id) rn "
        "from movimentos) r left join abertas using (dia, chave, valor)", _LEDGER),
    "plan_after_match": _sql(
        "select id, cast(previsto as double) previsto, cast(pago as double) pago from linhas_depois", _RUN),
    "ambiguous_cases": _sql(
        "select id movimento_id, cast(valor as double) valor, ids candidatos from casos", _CASES),
    "audit_before": _sql(
        "select cast(dia as varchar) dia, cast(sum(f) as bigint) sem_match_fwd, "
        "cast(sum(r) as bigint) sem_match_rev from ("
        "select m.dia, case when a.n is null then 1 else 0 end f, 0 r "
        "from movimentos m left join abertas a using (dia, chave, valor) "
        "union all select l.dia, 0, case when not exists (select 1 from movimentos m where m.dia = l.dia "
        "and m.chave = l.chave and m.valor = l.previsto) then 1 else 0 end "
        "from linhas l where pago is null and previsto is not null) group by dia", _LEDGER),
    "audit_after": _sql(
        "select cast(dia as varchar) dia, cast(sum(f) as bigint) sem_match_fwd, "
        "cast(sum(r) as bigint) sem_match_rev from ("
        "select m.dia, case when not exists (select 1 from linhas_depois l where l.dia = m.dia "
        "and l.chave = m.chave and l.previsto = m.valor and l.pago is null) then 1 else 0 end f, 0 r "
        "from movimentos m "
        "union all select l.dia, 0, case when not exists (select 1 from movimentos m where m.dia = l.dia "
        "and m.chave = l.chave and m.valor = l.previsto) then 1 else 0 end "
        "from linhas_depois l where pago is null and previsto is not null) group by dia", _RUN),
    "movement_status": _sql(
        "select e.id, tipo_match, linha_id, imputacao linha_imputacao "
        "from estado e left join linhas l on l.id = e.linha_id", _RUN),
    "state_counts": _sql(
        "select cast(dia as varchar) dia, s estado, count(*) filter (s = case when day(dia) % 2 = 0 "
        "then tipo_match else 'por_processar' end) quantidade from estado, "
        "(select unnest(['exato','ambiguo','novo','por_processar']) s) group by all", _RUN),
    "apply_decisions": _sql(
        "select id caso_id, coalesce(resolucao, 'novo') resolucao, "
        "case when resolucao is null then 'novo' else 'exato' end tipo_match from casos", _CASES),
    "open_cases": _sql(
        "select id caso_id, n n_candidatos, primeiro grupo, null pagina, null linhas from casos where resolucao is null "
        "union all select null, null, grupo, pagina, string_agg(id || ':' || linha || ':' || tipo || ':' || imputacao, ',' order by id) "
        "from candidatas where aberto group by grupo, pagina", _PAGES),
    "queue_size": _sql("select count(*) por_resolver from casos where resolucao is null", _CASES),
    "companies": _sql("select distinct empresa from movimentos", _LEDGER),
    "company_history": _sql(
        f"select id, {_DAY}, descricao, cast(valor as double) valor from movimentos "
        "where chave = 'CUSTOMER000000007'", _LEDGER),
    "daily_summary": _sql(
        f"select {_DAY}, cast(recebimentos as double) recebimentos, cast(pagamentos as double) pagamentos "
        "from resumo", _FLOWS),
    "day_totals": _sql(
        f"select {_DAY}, cast(coalesce(sum(valor) filter (valor > 0), 0) as double) total_recebimentos, "
        "count(*) filter (valor > 0) n_recebimentos, "
        "cast(coalesce(sum(-valor) filter (valor < 0), 0) as double) total_pagamentos, "
        "count(*) filter (valor < 0) n_pagamentos from fluxos group by dia", _FLOWS),
    "month_to_date": _sql(
        f"select {_DAY}, cast(r as double) recebimentos, cast(p as double) pagamentos, "
        "cast(sum(r - p) over (partition by date_trunc('month', dia) order by dia) as double) balanco from ("
        "select dia, coalesce(sum(valor) filter (valor >= 0), 0) r, "
        "coalesce(sum(-valor) filter (valor < 0), 0) p from movimentos group by dia)", _LEDGER),
    "summary_unpivot": _sql(
        f"select {_DAY}, 'Recebimentos' tipo, cast(recebimentos as double) valor from resumo "
        f"union all select {_DAY}, 'Pagamentos', cast(pagamentos as double) from resumo", _FLOWS),
    "balance_unpivot": _sql(
        f"select entidade, {_DAY}, 'Saldo contabilístico' tipo, cast(saldo_contabilistico as double) valor "
        f"from saldos union all select entidade, {_DAY}, 'Saldo disponível', "
        "cast(saldo_disponivel as double) from saldos", _FLOWS),
    "company_daily_net": _sql(
        f"select chave, {_DAY}, cast(sum(valor) as double) valor, "
        "case when sum(valor) >= 0 then 'Entradas' else 'Saídas' end sinal from fluxos group by chave, dia",
        _FLOWS),
    "balance_lookup": _sql(
        f"select {_DAY}, entidade, cast(saldo_contabilistico as double) saldo_contabilistico, "
        "cast(saldo_disponivel as double) saldo_disponivel from saldos where chave = 'CONTA7'", _FLOWS),
    "balances_latest": _sql(
        f"select entidade, {_DAY}, cast(saldo_contabilistico as double) saldo_contabilistico, "
        "cast(saldo_disponivel as double) saldo_disponivel from saldos "
        "qualify row_number() over (partition by entidade order by saldos.dia desc, id desc) = 1", _FLOWS),
    "balances_asof": _sql(
        "select cast(em as varchar) em, entidade, cast(max(s.dia) as varchar) dia, "
        "cast(arg_max(saldo_contabilistico, s.dia) as double) saldo_contabilistico, "
        "cast(arg_max(saldo_disponivel, s.dia) as double) saldo_disponivel from ("
        "select cast(unnest(generate_series(inicio, fim, interval 1 day)) as date) em "
        "from (select min(dia) inicio, max(dia) fim from saldos)) "
        "join saldos s on s.dia <= em group by em, entidade", _FLOWS),
    "balance_total": _sql(
        "select cast(em as varchar) em, count(*) entidades, cast(sum(c) as double) saldo_contabilistico_total, "
        "cast(sum(d) as double) saldo_disponivel_total from ("
        "select em, entidade, arg_max(saldo_contabilistico, s.dia) c, arg_max(saldo_disponivel, s.dia) d from ("
        "select cast(unnest(generate_series(inicio, fim, interval 1 day)) as date) em "
        "from (select min(dia) inicio, max(dia) fim from saldos)) "
        "join saldos s on s.dia <= em group by em, entidade) group by em", _FLOWS),
    "balance_top10": _sql(
        f"select entidade, {_DAY}, cast(saldo_contabilistico as double) saldo_contabilistico, "
        "cast(saldo_disponivel as double) saldo_disponivel from (select * from saldos "
        "qualify row_number() over (partition by entidade order by dia desc, id desc) = 1) u "
        "order by u.saldo_contabilistico desc, entidade limit 10", _FLOWS),
    "balance_series": _sql(
        f"select chave serie, row_number() over (partition by chave order by saldos.dia, id) - 1 t, {_DAY}, "
        "cast(saldo_contabilistico as double) valor from saldos", _FLOWS),
    "cashflow_series": _sql(
        f"select serie, {_DAY}, cast(recebimentos as double) recebimentos, cast(pagamentos as double) pagamentos, "
        "valor liquido from serie", _SERIES),
    "forecast_linear": _sql(
        f"select serie, {_DAY}, round(valor, 4) valor from previsto where modelo = 'regressao_linear'", _SERIES),
    "forecast_moving_average": _sql(
        f"select serie, {_DAY}, round(valor, 4) valor from previsto where modelo = 'media_movel'", _SERIES),
    "forecast_features": _sql(
        f"select serie, {_DAY}, isodow(serie.dia) - 1 dia_semana, day(serie.dia) dia_mes, "
        "cast(isodow(serie.dia) >= 6 as bigint) fim_de_semana, round(lag(valor, 1) over w, 4) lag_1, "
        "round(lag(valor, 2) over w, 4) lag_2, round(lag(valor, 3) over w, 4) lag_3, "
        "round(avg(valor) over (partition by serie order by t rows between 5 preceding and 1 preceding), 4) "
        "media_movel_5, round(valor, 4) valor from serie "
        "window w as (partition by serie order by t) qualify t >= 3", _SERIES),
    "forecast_too_short": _sql(
        "select chave serie, count(*) n, 'só há ' || count(*) || ' pontos e são precisos 25' motivo "
        "from saldos group by chave having count(*) < 25", _FLOWS),
    "chart_series": _sql(
        f"select serie, {_DAY}, round(valor, 4) valor, 'Histórico' nome, 'Histórico' tipo_linha from serie "
        f"union all select serie, {_DAY}, round(valor, 4), case modelo when 'media_movel' then 'Média móvel' "
        "else 'Regressão linear' end, 'Previsão' from previsto", _SERIES),
    "backtest_simple": _sql("select serie, modelo, round(rmse, 4) rmse from erros", _BACKTEST),
    "best_simple_model": _sql(
        "select serie, arg_min(modelo, (rmse, ordem)) melhor_modelo from erros group by serie", _BACKTEST),
    "anomaly_eligible": _sql(
        "select empresa, count(*) n from fluxos group by empresa having count(*) >= 10", _FLOWS),
    "script_status": _sql(
        "select nome, descricao, hora_execucao, status, ultima_execucao, ultima_erro, atrasado, hora_em_falta, "
        "case when atrasado then '⏰ Atrasado (esperado ' || hora_em_falta || ')' when status = 'ok' then '✅ OK' "
        "when status = 'erro' then '❌ Erro' else status end status_badge from situacao", _RUNS),
    "overdue": _sql("select nome, atrasado, hora_em_falta from situacao", _RUNS),
    "late_scripts": _sql(
        "select coalesce(string_agg(nome, ', ' order by nome), '') atrasados from situacao where atrasado", _RUNS),
    "recent_runs": _sql(
        "select id, r.timestamp, script, nivel, mensagem, detalhe from registos r "
        "order by ts desc, id desc limit 50", _RUNS),
    "runs_of_script": _sql(
        "select id, u.timestamp, script, nivel, mensagem, detalhe from (select * from registos "
        "order by ts desc, id desc limit 100) u where script = 'error'", _RUNS),
    "record_runs": _sql(
        "select id, script, status, cast(id % 2 = 0 as bigint) n_log from execucoes", _RUNS),
    "log_errors": "select strftime(ts, '%Y-%m-%d') dia, count(*) n from events "
                  "where event_type = 'error' or value > 200 group by 1",
    "similar_cases": """select caso_id, rank, vizinho_id from (
        select a.vec_id caso_id, b.vec_id vizinho_id, row_number() over (partition by a.vec_id order by
          list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) desc, b.vec_id) rank
        from embeddings a, embeddings b where a.vec_id % 10 = 0 and b.vec_id % 10 <> 0) where rank <= 3""",
    "prompts": _sql("""
        select c.id caso_id, primeiro grupo, null pagina, null texto, concat_ws(chr(10),
          'Este movimento bancário corresponde a várias linhas do mapa com a mesma empresa e o mesmo valor. '
          || 'Escolhe a linha certa, ou nenhuma se for um movimento novo.',
          'Movimento: ' || empresa || ' | valor ' || valor || ' EUR', 'Linhas candidatas:') antes,
          concat_ws(chr(10), 'Casos parecidos já resolvidos:',
          coalesce(exemplos, '(sem casos parecidos resolvidos anteriormente)'),
          'Responde só com JSON: {"linha_id": <id ou null>, "justificacao": "<texto curto>"}') depois
        from casos c left join semelhantes s on s.id = c.id
        where resolucao is null
        union all
        select null, grupo, pagina, string_agg('- linha ' || linha || ' (' || tipo || '): empresa '
          || empresa || ', previsto ' || previsto || ', imputação: ' || imputacao, chr(10) order by id), null, null
        from candidatas where aberto group by grupo, pagina""", _PAGES + """,
        vetores as (
          select c.*, cast(embedding as double[]) e from casos c
          join embeddings on vec_id = (c.id // 2) % (select count(*) from embeddings)),
        pares as (
          select a.id, b.empresa || ' | ' || b.descricao || ' | ' || b.valor || ' EUR' texto, b.resolucao,
            list_cosine_similarity(a.e, b.e) sim, b.id vizinho,
            row_number() over (partition by a.id order by list_cosine_similarity(a.e, b.e) desc, b.id) r
          from vetores a, vetores b where a.resolucao is null and b.resolucao is not null),
        semelhantes as (
          select id, string_agg('- Caso: ' || texto || ' -> resolvido como: ' || resolucao || ' (similaridade '
            || printf('%.2f', sim) || ')', chr(10) order by r) exemplos from pares where r <= 3 group by id)"""),
    "suggestions": _sql(
        "select id caso_id, case (id // 2) % 4 when 1 then 'novo' when 2 then null "
        "else 'linha_id=' || primeiro end resolucao_sugerida, "
        "case (id // 2) % 4 when 1 then 'nenhuma' when 2 then "
        "'[resposta do LLM não veio em JSON válido] não sei, caso ' || id else 'bate com o histórico' end "
        "justificacao_sugerida, cast(null as varchar) resolvido_por from casos", _CASES),
    "answers_rejected": _sql("select -id caso_id, 'caso desconhecido' motivo from casos where id % 3 = 0", _CASES),
    "transcripts": """select conv_id,
        regexp_replace(regexp_replace(coalesce(string_agg(text, '' order by turn) filter (role <> 'system'), ''),
          '^\\s+', ''), '\\s+$', '') resposta,
        coalesce(string_agg(text, chr(10) order by turn) filter (role = 'system' and text <> ''), '') ferramentas
        from conversations group by conv_id""",
    "import_plan": _sql("""
        select cast(d as varchar) dia, tabela, case
          when tabela = 'linhas' and d not in (select dia from linhas) then 'sem ficheiro'
          when tabela <> 'linhas' and d not in (select dia from movimentos) then 'sem ficheiro'
          when day(d) % 2 <> 0 and d <> fim then 'importar'
          when tabela = 'saldos' and d = fim then 'atualizar' else 'presente' end acao
        from (select cast(unnest(generate_series(inicio, fim + 1, interval 1 day)) as date) d, fim
          from (select min(dia) inicio, max(dia) fim
            from (select dia from movimentos union all select dia from linhas))),
          (select unnest(['movimentos', 'saldos', 'linhas']) tabela)""", _LEDGER),
    "workbook_import": _sql(
        "select cast(s.dia as varchar) dia, s.entidade empresa, n, cast(total as double) total, "
        "cast(saldo_contabilistico as double) saldo_contabilistico, "
        "cast(saldo_disponivel as double) saldo_disponivel from saldos s join "
        "(select dia, empresa, count(*) n, sum(valor) total from fluxos group by all) f "
        "on f.dia = s.dia and f.empresa = s.entidade", _FLOWS),
    "plan_import": _sql(
        f"select {_DAY}, tipo, chave, count(*) n, cast(sum(previsto) as double) previsto, "
        "cast(sum(pago) as double) pago, max(imputacao) imputacao from linhas group by linhas.dia, tipo, chave",
        _LEDGER),
}
_FOREST = "recursive " + _FLOWS + "," + forest_sql.FOREST
ORACLE["anomaly_models"] = _sql(
    "select empresa, count(*) - 1 n_cortes, round(min(nota), 6) menor, round(max(nota), 6) maior from floresta group by empresa", _FOREST)
ORACLE["anomaly_flags"] = _sql(
    "select id, empresa, cast(valor as double) valor, round(nota, 4) score "
    "from pontuada join limiar using (empresa) join fluxos using (id, empresa) where altura < limite", _FOREST)
ORACLE["forecast_holt"] = recursive_sql.holt(_SERIES)
ORACLE["forecast_arima"] = recursive_sql.arima(_SERIES)
_MIDDLE = "(select min(dia) + cast((max(dia) - min(dia)) // 2 as integer) from fluxos)"
_LAST = "(select max(dia) from fluxos)"
ORACLE |= {
    "state_report": _sql(
        "select cast(dia as varchar) dia, s.nome estado, count(*) filter (tipo_match = s.estado) quantidade "
        "from estado, (values ('exato', 'Casados'), ('ambiguo', 'Ambíguos'), ('novo', 'Novos'), "
        "('por_processar', 'Por processar')) s(estado, nome) group by all", _RUN),
    "decisions_rejected": _sql(
        "select case when id % 3 <> 0 then id else -id end caso_id, -id linha_id, "
        "case when id % 3 <> 0 then 'linha não é candidata' else 'caso desconhecido' end motivo from casos", _CASES),
    "rmse_table": _sql(
        "select case modelo when 'media_movel' then 'Média móvel' else 'Regressão linear' end modelo, "
        "round(rmse, 4) rmse_eur from erros where serie = '*'", _BACKTEST),
    "case_cosines": "select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), "
                    "cast(b.embedding as double[])), 6) semelhanca "
                    "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "import_day": _sql(
        f"select {_DAY}, 'movimentos' tabela, count(*) n, cast(sum(valor) as double) total from fluxos "
        f"where fluxos.dia = {_MIDDLE} group by fluxos.dia union all "
        f"select {_DAY}, 'saldos', count(*), cast(sum(saldo_contabilistico) as double) from saldos "
        f"where saldos.dia = {_MIDDLE} group by saldos.dia", _FLOWS),
    "import_recent": _sql(
        f"select 1 volta, {_DAY}, 'movimentos' tabela, count(*) linhas from fluxos group by fluxos.dia union all "
        f"select 1, {_DAY}, 'saldos', count(*) from saldos group by saldos.dia union all "
        f"select 2, {_DAY}, 'saldos', count(*) from saldos where saldos.dia = {_LAST} group by saldos.dia", _FLOWS),
    "import_errors": _sql(
        f"select {_DAY}, tabela, coalesce(erros, 0) erros, case when erros is null then n else 0 end linhas "
        "from contados left join estragados using (dia)", _FLOWS + """,
        estragados as (
          select dia, count(distinct id // 32768) erros from fluxos
          where empresa = 'Conta 7, SA' and day(dia) % 2 = 0 group by dia),
        contados as (
          select dia, 'movimentos' tabela, count(*) n from fluxos group by dia
          union all select dia, 'saldos', count(*) from saldos group by dia)"""),
    "balances_refreshed": _sql(
        f"select {_DAY}, entidade, cast(case when saldos.dia = {_LAST} then 2 * saldo_contabilistico "
        "else saldo_contabilistico end as double) saldo_contabilistico from saldos", _FLOWS),
    "runs_recorded": "select strftime(ts, '%Y-%m-%d') dia, event_type script, 2 * count(*) n, 2 * count(*) ids "
                     "from events group by all",
    "stream_import": _sql(
        f"select {_DAY}, count(*) n, count(*) ids, cast(sum(valor) as double) total from fluxos group by fluxos.dia", _FLOWS),
    "archived_logs": "select strftime(ts, '%Y-%m-%d') dia, count(*) n from events group by 1",
}
