from datetime import date

from conftest import money

from bankrec.operators import balances, reports, series


def s(i, dia, entidade, c, d):
    return dict(id=i, dia=date(2026, 7, dia), entidade=entidade, saldo_contabilistico=c, saldo_disponivel=d)


def test_latest_and_total(saldos):
    df = saldos([s(1, 20, "A", 100, 90), s(2, 21, "A", 150, 140), s(3, 20, "B", 50, 50)])
    t = balances.total(balances.latest(df)).first()
    assert (t.entidades, t.saldo_contabilistico_total, t.saldo_disponivel_total) == (2, 200, 190)
    assert balances.top(balances.latest(df), 1).first().entidade == "A"
    assert balances.total(balances.latest(df.where("false"))).first().saldo_disponivel_total == 0


def test_as_of(saldos):
    df = saldos([s(1, 20, "A", 100, 90), s(2, 24, "A", 250000, 57000)])
    assert balances.latest(df, date(2026, 7, 21)).first().saldo_contabilistico == money(100)
    assert balances.latest(df, date(2026, 7, 25)).first().saldo_contabilistico == money(250000)
    assert balances.latest(df, date(2026, 7, 19)).count() == 0
    daily = {r.em.day: r.saldo_disponivel for r in
             balances.latest_between(df, date(2026, 7, 19), date(2026, 7, 26)).collect()}
    assert daily == {20: 90, 21: 90, 22: 90, 23: 90, 24: 57000, 25: 57000, 26: 57000}


def test_null_reading_counts_as_last_and_ties_go_to_the_last_id(saldos):
    df = saldos([s(1, 20, "A", 100, 90), s(2, 21, "A", 5, 5), s(3, 21, "A", None, 7)])
    last = balances.latest(df).first()
    assert last.saldo_contabilistico is None and last.saldo_disponivel == money(7)
    assert balances.total(balances.latest(df)).first().saldo_contabilistico_total == 0
    day = [r for r in balances.latest_between(df, date(2026, 7, 21), date(2026, 7, 22)).collect()]
    assert [r.saldo_contabilistico for r in day] == [None, None]


def test_lookup_by_key(saldos):
    df = saldos([s(1, 20, "Empresa Teste,LDA", 100, 90), s(2, 21, "EMPRESA TESTE", 1, 1), s(3, 21, "Outra", 1, 1)])
    assert balances.lookup(df, "empresa teste").count() == 2
    assert balances.lookup(df, "empresa teste", date(2026, 7, 21)).count() == 1


def test_positions_keep_duplicates(saldos, monkeypatch):
    monkeypatch.setattr(series, "_IDS_PER_BLOCK", 2)
    df = saldos([s(i, 20 + i // 4, "A" if i % 2 else "A, LDA", i, 0) for i in range(11)] + [s(50, 21, "A", None, 1)])
    got = sorted((r.t, r.valor) for r in series.balance_series(df).collect())
    assert got == [(i, float(i)) for i in range(11)]


def test_unpivot_labels(saldos):
    df = saldos([s(1, 20, "A", 100, 90)])
    rows = reports.unpivot_series(df, ["dia"], ["saldo_contabilistico", "saldo_disponivel"]).collect()
    assert {(r.tipo, float(r.valor)) for r in rows} == {("Saldo contabilístico", 100.0), ("Saldo disponível", 90.0)}
