import random
from datetime import date, datetime

import pytest
from conftest import money
from pyspark.sql import functions as F

from bankrec import schema
from bankrec.operators import cases, cashflow, reconcile

DIA = date(2026, 7, 21)
SPELLINGS = {"ANCORAAPOGEU": ["ANCORA APOGEU,LDA", "Ancora Apogeu", "Âncora  Apogeu, S.A."],
             "PALAVRA": ["Palavra", "PALAVRA SA"], "": ["DE SA", "Lda"]}


def mov(i, empresa, valor, dia=DIA, descricao="TRANSF"):
    return dict(id=i, dia=dia, empresa=empresa, descricao=descricao, valor=valor, ficheiro_origem="x.xlsx")


def line(i, empresa, previsto, pago=None, linha=5, dia=DIA, imputacao=None):
    return dict(id=i, dia=dia, tipo="pagamento", linha=linha, empresa=empresa, previsto=previsto,
                pago=pago, imputacao=imputacao)


def literal(movements, lines):
    """Movements one by one, each against every open line."""
    used, out = set(), {}
    for m in sorted(movements, key=lambda m: m["id"]):
        hits = [l for l in lines if l["id"] not in used and l["dia"] == m["dia"] and l["chave"] == m["chave"]
                and l["previsto"] is not None and l["pago"] is None and l["previsto"] == m["valor"]]
        if len(hits) == 1:
            used.add(hits[0]["id"])
            out[m["id"]] = ("exato", hits[0]["id"], None)
        elif hits:
            out[m["id"]] = ("ambiguo", None, tuple(sorted(h["id"] for h in hits)))
        else:
            out[m["id"]] = ("novo", None, None)
    return out


def random_ledger(seed, n=120, hot=False):
    rng = random.Random(seed)
    days = [DIA, date(2026, 7, 22)]

    def pick():
        if hot and rng.random() < 0.4:
            return "ANCORAAPOGEU", 10.0, DIA
        return rng.choice(list(SPELLINGS)), rng.choice([10.0, -10.0, 10.01, 0.0, 99.99]), rng.choice(days)

    movements, lines = [], []
    for i in range(n):
        key, value, dia = pick()
        movements.append({**mov(i * 3 + 1, rng.choice(SPELLINGS[key]), value, dia), "chave": key})
    for i in range(n // 4 if not hot else 1):
        key, value, dia = pick()
        pago = value if rng.random() < 0.3 else None
        previsto = None if rng.random() < 0.1 else value
        lines.append({**line(i * 2 + 1, rng.choice(SPELLINGS[key]), previsto, pago, dia=dia), "chave": key})
    return movements, lines


@pytest.mark.parametrize("seed,hot,min_rows", [(1, False, 10**6), (2, False, 1), (3, True, 1), (4, True, 10**6)])
def test_closed_form_equals_the_literal_loop(movimentos, linhas, seed, hot, min_rows):
    ms, ls = random_ledger(seed, hot=hot)
    if hot:
        ls = ls + [{**line(999, "Ancora Apogeu", 10.0), "chave": "ANCORAAPOGEU"}]
    m, l = movimentos([{k: v for k, v in x.items() if k != "chave"} for x in ms]), linhas(
        [{k: v for k, v in x.items() if k != "chave"} for x in ls])
    run = reconcile.classify(m, l, min_rows)
    want = literal(ms, ls)
    got = {r.id: (r.tipo_match, r.linha_id) for r in run.collect()}
    assert got == {i: w[:2] for i, w in want.items()}
    options = cases.candidates(run, l)
    found = cases.with_candidates(cases.ambiguous_cases(run), options)
    assert {r.id: tuple(r.candidatos) for r in found.collect()} == {
        i: w[2] for i, w in want.items() if w[0] == "ambiguo"}
    total = {r.dia: (r.casados, r.novos, r.ambiguos) for r in reconcile.summary(m, l).collect()}
    for dia in total:
        kinds = [want[x["id"]][0] for x in ms if x["dia"] == dia]
        assert total[dia] == tuple(kinds.count(k) for k in ("exato", "novo", "ambiguo"))


def test_two_runs_in_a_row(movimentos, linhas):
    ms, ls = random_ledger(7)
    strip = lambda xs: [{k: v for k, v in x.items() if k != "chave"} for x in xs]
    first, second = ms[:60], ms
    l = linhas(strip(ls))
    run1 = reconcile.classify(movimentos(strip(first)), l)
    done = reconcile.reconciliations(run1)
    l2 = reconcile.lines_after(l, run1)
    run2 = reconcile.classify(reconcile.pending(movimentos(strip(second)), done), l2)
    got = {r.id: r.tipo_match for r in run1.collect()} | {r.id: r.tipo_match for r in run2.collect()}
    want1 = literal(first, ls)
    used = {w[1] for w in want1.values() if w[0] == "exato"}
    after = [{**x, "pago": 1 if x["id"] in used else x["pago"]} for x in ls]
    want = want1 | literal(ms[60:], after)
    assert got == {i: w[0] for i, w in want.items()}
    assert run2.where("id <= 178").count() == 0


@pytest.mark.parametrize("ms,ls,expected", [
    ([("ANCORA APOGEU,LDA", -100)], [("Ancora Apogeu", -100, None)], (1, 0, 0)),
    ([("ANCORA APOGEU,LDA", -100)], [("Ancora Apogeu", -100, -100)], (0, 1, 0)),
    ([("EMPRESA SEM MAPA,LDA", -50)], [], (0, 1, 0)),
    ([("ANCORA APOGEU,LDA", -100)], [("Ancora Apogeu", -100, None), ("Ancora Apogeu", -100, None)], (0, 0, 1)),
    ([("A", 1), ("A", 1)], [("A", 1, None)], (1, 1, 0)),
    ([("A", 1), ("A", 1)], [("A", 1, None), ("A", 1, None)], (0, 0, 2)),
    ([("DE SA", 1)], [("Lda", 1, None)], (1, 0, 0)),
])
def test_examples(movimentos, linhas, ms, ls, expected):
    m = movimentos([mov(i, e, v) for i, (e, v) in enumerate(ms, 1)])
    l = linhas([line(i, e, p, pago) for i, (e, p, pago) in enumerate(ls, 1)])
    r = reconcile.summary(m, l).first()
    assert (r.casados, r.novos, r.ambiguos) == expected
    kinds = [x.tipo_match for x in reconcile.classify(m, l).collect()]
    assert tuple(kinds.count(k) for k in ("exato", "novo", "ambiguo")) == expected


def test_repeat_changes_nothing_and_lines_are_paid(movimentos, linhas, spark):
    m, l = movimentos([mov(1, "ANCORA APOGEU,LDA", -100)]), linhas([line(1, "Ancora Apogeu", -100, imputacao="Renda")])
    run = reconcile.classify(m, l)
    done = reconcile.reconciliations(run)
    after = reconcile.lines_after(l, run)
    assert after.first().pago == money(-100)
    assert reconcile.apply_matches(l, done, m).first().pago == money(-100)
    again = reconcile.pending(m, done)
    dias = spark.createDataFrame([(DIA,)], "dia date")
    r = reconcile.summary(again, after, dias).first()
    assert (r.casados, r.novos, r.ambiguos) == (0, 0, 0)
    status = reconcile.movement_status(m, done, l).first()
    assert (status.tipo_match, status.linha_id, status.linha_imputacao) == ("exato", 1, "Renda")
    unprocessed = reconcile.movement_status(m, done.where("false"), l)
    assert unprocessed.first().tipo_match is None
    counts = {r.estado: r.quantidade for r in reconcile.state_counts(unprocessed).collect()}
    assert counts == {"exato": 0, "ambiguo": 0, "novo": 0, "por_processar": 1}


def test_audit_before_and_after(movimentos, linhas):
    m = movimentos([mov(1, "SEM MAPA,LDA", -50), mov(2, "ANCORA APOGEU,LDA", -100)])
    l = linhas([line(1, "Outra Empresa", -30), line(2, "Ancora Apogeu", -100)])
    r = reconcile.audit(m, l).first()
    assert (r.sem_match_fwd, r.sem_match_rev) == (1, 1)
    # a matched movement has no open line any more, so it counts once its line is paid
    r = reconcile.audit(m, reconcile.lines_after(l, reconcile.classify(m, l))).first()
    assert (r.sem_match_fwd, r.sem_match_rev) == (2, 1)


def _ambiguous(movimentos, linhas):
    m = movimentos([mov(1, "ANCORA APOGEU,LDA", -100), mov(2, "Ancora Apogeu", -100)])
    l = linhas([line(1, "Ancora Apogeu", -100, linha=5), line(2, "Ancora Apogeu", -100, linha=9),
                line(3, "Outra", -100)])
    run = reconcile.classify(m, l)
    return m, l, cases.ambiguous_cases(run), cases.candidates(run, l), reconcile.reconciliations(run)


def test_decisions(spark, movimentos, linhas):
    m, l, found, options, recs = _ambiguous(movimentos, linhas)
    assert options.count() == 2 and found.count() == 2
    assert [d.linha for d in cases.open_cases(found, options, l).first().candidatos_detalhe] == [5, 9]
    at = lambda h: datetime(2026, 7, 22, h)
    decisions = spark.createDataFrame(
        [(1, 1, "ana", at(9)), (1, 2, "rui", at(10)), (2, None, "ana", at(9)),
         (1, 3, "eva", at(11)), (77, 1, "eva", at(9))], schema.DECISOES)
    done = cases.apply_decisions(decisions, found, options, recs, l)
    got = {r.id: (r.resolucao, r.resolvido_por) for r in done.casos.collect()}
    assert got == {1: ("linha_id=2", "rui"), 2: ("novo", "ana")}
    # the reconciliation follows the first decision, both chosen lines are paid
    assert {r.movimento_id: (r.tipo_match, r.linha_id) for r in done.reconciliacoes.collect()} == {
        1: ("exato", 1), 2: ("novo", None)}
    assert {r.id: r.pago for r in done.linhas.collect()} == {1: money(-100), 2: money(-100), 3: None}
    assert {(r.caso_id, r.linha_id) for r in done.rejeitados.collect()} == {(1, 3), (77, 1)}
    assert cases.open_cases(done.casos, options, l).count() == 0
    assert cases.queue_size(found).first().por_resolver == 2


def test_a_group_of_any_size_has_all_its_candidates(movimentos, linhas):
    m = movimentos([mov(1, "A", -100), mov(2, "A", -100)])
    l = linhas([line(i, "A", -100) for i in range(1, 1002)])
    found = reconcile.classify(m, l)
    options, found = cases.candidates(found, l), cases.ambiguous_cases(found)
    assert [len(r.candidatos) for r in cases.with_candidates(found, options).collect()] == [1001, 1001]
    assert [len(r.candidatos_detalhe) for r in cases.open_cases(found, options, l).collect()] == [1001, 1001]
    # pages hold each candidate once, whatever the number of cases
    got = cases.pages(cases.of_open_cases(options, found), l, 100).collect()
    assert {(r.grupo, r.pagina) for r in got} == {(1, p) for p in range(11)}
    ids = [[d.id for d in r.candidatos_detalhe] for r in got]
    assert all(p == sorted(p) and len(p) < 150 for p in ids) and sorted(sum(ids, [])) == list(range(1, 1002))
    assert cases.pages(cases.of_open_cases(options, found.withColumn("resolvido_por", F.lit("ana"))), l).count() == 0


def test_listings(movimentos):
    m = movimentos([mov(1, "PALAVRADICIONAL,LDA", 1), mov(2, "ANCORA APOGEU,LDA", -50),
                    mov(3, "Ancora Apogeu", 30, date(2026, 7, 20)), mov(4, "ANCORA APOGEU,LDA", 0)])
    names = [r.empresa for r in cashflow.companies(m).collect()]
    assert names == sorted(names) and len(names) == 3
    rows = cashflow.company_history(m, "Âncora Apogeu, S.A.").collect()
    assert [(r.id, r.valor) for r in rows] == [(3, money(30)), (2, money(-50)), (4, money(0))]
    day = {r.dia: (r.recebimentos, r.pagamentos) for r in cashflow.daily_summary(m).collect()}
    assert day == {DIA: (1, 50), date(2026, 7, 20): (30, 0)}
    totals = {r.dia: (r.n_recebimentos, r.n_pagamentos) for r in cashflow.day_totals(m).collect()}
    assert totals == {DIA: (1, 1), date(2026, 7, 20): (1, 0)}
    balance = {r.dia.day: r.balanco for r in cashflow.month_to_date(m).collect()}
    assert balance == {20: 30, 21: -19}


def test_movements_are_shuffled_once(movimentos, linhas):
    """Row-level movements cross one exchange on the match key; the others carry
    aggregates or lookups."""
    m, l = movimentos([mov(1, "A", 1)]), linhas([line(1, "A", 1)])
    plan = reconcile.classify(m, l)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    by_key = [p for p in plan.splitlines() if "Exchange hashpartitioning(dia" in p and "_chave" in p]
    assert len(by_key) == 1 and "Window" not in plan      # the lookup is where its aggregate left it


def test_the_query_gives_each_case_all_its_candidates(spark, tmp_path):
    from datetime import datetime
    from bankrec.plans import registry
    orders = [(k, 1, "O", 10.5, datetime(2024, 1, 2), "1-URGENT") for k in (11, 12)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.ambiguous_cases(spark, str(tmp_path)).collect()
    assert {(r.movimento_id, r.valor, r.candidatos) for r in got} == {(22, 10.5, "22,23,24"), (24, 10.5, "22,23,24")}
