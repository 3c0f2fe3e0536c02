"""Statements are parsed once, whatever is made of them, and days are told by file."""

from datetime import date

from bankrec import schema
from bankrec.operators import ingest
from bankrec.plans.workbooks import statement
from bankrec.session import shared_folder
from bankrec.sources import statements, workbook
from bankrec.streaming import imports
from conftest import money

DAYS = [date(2026, 7, 21), date(2026, 7, 22)]


def files(spark):
    return spark.createDataFrame([(
        f"/d/FINANCEIRO/07_Julho/{d:%d-%m-%Y}/{d:%d-%m-%Y}_{name}.xlsx",
        statement([("x", money(1)), ("y", money(-2))], f"{d:%d-%m-%Y}", money(5 * n), money(4))) for d in DAYS
        for n, name in enumerate("AB", 1)], "path string, content binary")


def ledger(spark):
    root = shared_folder(spark)
    schema.create_tables(spark, root)
    return root


def counted(monkeypatch, *names):
    calls = []
    for name in names:
        given = getattr(statements, name)
        monkeypatch.setattr(statements, name, lambda *a, given=given, name=name: (calls.append(name), given(*a))[1])
    return calls


def test_balances_are_told_by_file(spark, monkeypatch):
    calls, root, cells = counted(monkeypatch, "closings"), ledger(spark), workbook.cells(files(spark))
    assert ingest.import_balances(root, cells).count() == 4
    assert ingest.refresh_balances(root, cells, DAYS[1]).count() == 2
    assert calls == ["closings"] * 2
    assert sorted((r.dia, r.entidade, int(r.saldo_contabilistico)) for r in schema.read_table(spark, root, "saldos").collect()) == [
        (d, name, 5 * n) for d in DAYS for n, name in enumerate("AB", 1)]


def test_one_import_reads_balances_once(spark, monkeypatch):
    calls, root, cells = counted(monkeypatch, "closings", "raw_movements"), ledger(spark), workbook.cells(files(spark))
    report, errors = ingest.import_cells(root, cells, None, DAYS, date(2026, 7, 23))
    assert sorted(calls) == ["closings", "raw_movements"]
    assert sorted(map(tuple, report.collect())) == [(DAYS[0], "movimentos", 4), (DAYS[0], "saldos", 2), (DAYS[1], "movimentos", 4), (
        DAYS[1], "saldos", 2)] and errors.count() == 0


def test_a_batch_of_the_stream_parses_statements_once(spark, monkeypatch):
    calls, root = counted(monkeypatch, "raw_movements"), ledger(spark)
    imports.import_batch(root, files(spark), 0)
    assert calls == ["raw_movements"]
    assert schema.read_table(spark, root, "movimentos").select("id").distinct().count() == 8
