from datetime import date
from decimal import Decimal

import pytest
from conftest import money

from bankrec import schema
from bankrec.operators import ingest, runs
from bankrec.plans.workbooks import statement, xlsx
from bankrec.sources import paths, plan_sheet, statements, workbook
from bankrec.streaming import imports

DIA = date(2026, 7, 21)
FOLDER = "FINANCEIRO/03 - Extratos Bancários/Movimentos Diários/CGD/07_Julho/21-07-2026"
SHEET = {"A1": "Saldo contabilístico", "B1": "100,00 EUR", "A2": "Saldo disponível", "B2": "90,00 EUR",
         "A5": "Data mov.", "A6": "21-07-2026", "B6": "21-07-2026", "C6": " TRANSF TESTE ", "D6": "-50,00"}
PLAN = {"A4": "Nº", "E5": "Ancora Apogeu", "D5": 166.29, "K5": "Ancora Apogeu", "I5": 45, "K6": "Palavra",
        "J6": 359.96, "I6": "=A1*2", "A8": "=SUM(C5:C7)", "E9": "depois dos totais"}


def cells(spark, files):
    return workbook.cells(spark.createDataFrame(list(files.items()), "path string, content binary"))


def put(root, name, content, folder=FOLDER):
    path = root / folder
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_bytes(content)


@pytest.fixture
def ledger(spark, tmp_path):
    schema.create_tables(spark, str(tmp_path / "bd"))
    return str(tmp_path / "bd"), tmp_path / "docs"


def test_statement(spark):
    sheet = {**SHEET, "A7": "x", "C7": "sem montante", "A8": "x", "D8": 50.0, "A9": "x", "D9": "1.234,56",
             "D10": "9,00", "A11": "depois do fim", "D11": "1,00"}
    got = statements.statement_movements(cells(spark, {f"/d/{FOLDER}/21-07-2026_Empresa Teste,LDA.xlsx": xlsx({"F": sheet})}))
    rows = got.orderBy("row").collect()
    assert [(r.row, r.descricao, r.valor) for r in rows] == [
        (6, "TRANSF TESTE", money(-50)), (8, "", money(50)), (9, "", money("1234.56"))]
    assert (rows[0].dia, rows[0].empresa, rows[0].chave) == (DIA, "Empresa Teste,LDA", "EMPRESATESTE")
    assert rows[0].ficheiro_origem == "21-07-2026_Empresa Teste,LDA.xlsx"


def test_a_missing_row_ends_the_statement(spark):
    sheet = {**SHEET, "A8": "x", "C8": "depois de uma linha vazia", "D8": "1,00"}
    assert statements.statement_movements(cells(spark, {f"/{FOLDER}/a.xlsx": xlsx({"F": sheet})})).count() == 1
    late = {"A21": "Data mov.", "A22": "x", "D22": "1,00"}
    assert statements.statement_movements(cells(spark, {f"/{FOLDER}/a.xlsx": xlsx({"F": late})})).count() == 0


def test_bad_amounts_and_files_are_rejected_whole(spark):
    bad = {**SHEET, "A7": "x", "C7": "y", "D7": "abc"}
    c = cells(spark, {f"/{FOLDER}/mau.xlsx": xlsx({"F": bad}), f"/{FOLDER}/bom.xlsx": xlsx({"F": SHEET}),
                      f"/{FOLDER}/partido.xlsx": b"isto nao e um zip"})
    assert [r.empresa for r in statements.statement_movements(c).collect()] == ["bom"]
    assert {r.path.split("/")[-1] for r in statements.rejected(c).collect()} == {"mau.xlsx", "partido.xlsx"}


def test_balances_take_the_last_label_and_the_last_file(spark):
    twice = {**SHEET, "A9": "Saldo contabilístico final", "B9": "7,00", "A12": "Saldo disponível", "B12": "1,00"}
    c = cells(spark, {f"/{FOLDER}/21-07-2026_A.xlsx": xlsx({"F": SHEET}), f"/{FOLDER}/22-07-2026_A.xlsx": xlsx({"F": twice}),
                      f"/{FOLDER}/21-07-2026_B.xlsx": xlsx({"F": {"A1": "nada"}})})
    got = {r.entidade: (r.saldo_contabilistico, r.saldo_disponivel) for r in statements.statement_balances(c).collect()}
    assert got == {"A": (money(7), money(90)), "B": (None, None)}


def test_plan_sheet(spark):
    path = "/CONTABILIDADE/13- Mapa de Pagamentos e Recebimentos/2026/07 - Mapa de Pagamentos  e Recebimentos de Julho.xlsx"
    c = cells(spark, {path: xlsx({"Resumo": {"A1": "x"}, "21": PLAN, "20": {"E5": "sem totais"}})})
    rows = plan_sheet.plan_lines(c).orderBy("tipo", "linha").collect()
    assert [(r.tipo, r.linha, r.empresa, r.previsto, r.pago) for r in rows] == [
        ("pagamento", 5, "Ancora Apogeu", money(-45), None), ("pagamento", 6, "Palavra", None, money("-359.96")),
        ("recebimento", 5, "Ancora Apogeu", None, money("166.29"))]
    wanted = spark.createDataFrame([(path, DIA), (path, date(2026, 7, 22))], "path string, dia date")
    assert {(r.dia.day, r.motivo) for r in plan_sheet.rejected(c, wanted).collect()} == {
        (20, "linha de totais não encontrada"), (22, "folha do dia não existe")}


def test_shared_strings_and_styles_of_real_writers(spark):
    import io
    import zipfile
    content = io.BytesIO(xlsx({"F": SHEET}))
    with zipfile.ZipFile(content, "a") as z:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Data mov.</t></si>'
                   '<si><r><t>par</t></r><r><t>tido</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>'
                   '<row r="2"><c r="A2" s="3"><v>46000</v></c><c r="C2" t="s"><v>1</v></c><c r="D2"><f>1+1</f><v>2</v></c></row>'
                   '</sheetData></worksheet>')
    rows = statements.statement_movements(cells(spark, {f"/{FOLDER}/a.xlsx": content.getvalue()})).collect()
    assert [(r.descricao, r.valor) for r in rows] == [("partido", money(2))]


def test_paths(spark):
    df = spark.createDataFrame([(f"/r/{FOLDER}/21-07-2026_Empresa Teste,LDA.xlsx", DIA)], "path string, dia date")
    r = df.select(paths.entity("path").alias("e"), paths.statement_day("path").alias("d"),
                  paths.statement_folder("/r", "dia").alias("f"), paths.plan_path("/r", "dia").alias("p")).first()
    assert (r.e, r.d, r.f) == ("Empresa Teste,LDA", DIA, f"/r/{FOLDER}")
    assert r.f == ingest.statement_folder("/r", DIA) and r.p == ingest.plan_file("/r", DIA)
    assert df.select(paths.plan_month(paths.plan_path("/r", "dia")).alias("m")).first().m == date(2026, 7, 1)


def test_import_recent(spark, ledger):
    root, docs = ledger
    put(docs, "21-07-2026_Empresa Teste,LDA.xlsx", xlsx({"F": SHEET}))
    plan = ingest.plan_file(str(docs), DIA)
    put(docs, plan.rsplit("/", 1)[1], xlsx({"21": PLAN}), plan.rsplit("/", 1)[0][len(str(docs)) + 1:])
    read = lambda t: schema.read_table(spark, root, t)
    report, errors = ingest.import_recent(spark, root, str(docs), date(2026, 7, 24))
    assert {(r.dia, r.tabela): r.linhas for r in report.collect()} == {
        (DIA, "movimentos"): 1, (DIA, "saldos"): 1, (DIA, "linhas"): 3}
    assert errors.count() == 0
    report, _ = ingest.import_recent(spark, root, str(docs), date(2026, 7, 24))
    assert report.count() == 0
    assert (read("movimentos").count(), read("saldos").count(), read("linhas").count()) == (1, 1, 3)
    # the day after, yesterday's provisional balances are read again
    put(docs, "21-07-2026_Empresa Teste,LDA.xlsx", xlsx({"F": {**SHEET, "B1": "250,00 EUR"}}))
    ingest.import_recent(spark, root, str(docs), date(2026, 7, 22))
    assert [r.saldo_contabilistico for r in read("saldos").collect()] == [money(250)]
    assert ingest.import_day(spark, root, str(docs), date(2026, 1, 1))[0].count() == 0


def test_balance_import_skips_known_entities(spark, ledger):
    root, _ = ledger
    c = cells(spark, {f"/{FOLDER}/21-07-2026_A.xlsx": xlsx({"F": SHEET})})
    assert ingest.import_balances(root, c).count() == 1
    more = cells(spark, {f"/{FOLDER}/21-07-2026_A.xlsx": xlsx({"F": SHEET}), f"/{FOLDER}/21-07-2026_B.xlsx": xlsx({"F": SHEET})})
    assert [r.entidade for r in ingest.import_balances(root, more).collect()] == ["B"]
    ids = [r.id for r in schema.read_table(spark, root, "saldos").collect()]
    assert len(set(ids)) == 2


def test_a_day_with_a_bad_file_waits(spark, ledger):
    root, docs = ledger
    put(docs, "21-07-2026_A.xlsx", xlsx({"F": SHEET}))
    put(docs, "21-07-2026_B.xlsx", xlsx({"F": {**SHEET, "D6": "abc"}}))
    _, errors = ingest.import_day(spark, root, str(docs), DIA)
    assert "abc" in errors.first().motivo and schema.read_table(spark, root, "movimentos").count() == 0
    put(docs, "21-07-2026_B.xlsx", xlsx({"F": SHEET}))
    ingest.import_day(spark, root, str(docs), DIA)
    assert schema.read_table(spark, root, "movimentos").select("id").distinct().count() == 2


def test_reconcile_and_decide_on_stored_tables(spark, ledger):
    root, _ = ledger
    rows = [("Renda", Decimal("-45.00")), ("Outro", Decimal("-45.00")), ("Nada", Decimal("3.00"))]
    c = cells(spark, {f"/{FOLDER}/21-07-2026_ANCORA APOGEU,LDA.xlsx": statement(rows[:1] + rows[2:], "21-07-2026"),
                      f"/{FOLDER}/21-07-2026_Palavra.xlsx": statement(rows[1:2], "21-07-2026")})
    ingest.import_movements(root, c)
    twice = {**PLAN, "I6": 45, "J6": None, "K7": "Palavra SA", "I7": 45}
    path = ingest.plan_file("", DIA)
    ingest.import_plan(root, cells(spark, {path: xlsx({"21": twice})}))
    r = runs.reconcile_days(spark, root).first()
    assert (r.casados, r.novos, r.ambiguos) == (1, 1, 1)
    assert runs.reconcile_days(spark, root).count() == 0
    read = lambda t: schema.read_table(spark, root, t)
    assert read("linhas").where("pago = -45").count() == 1
    case, option = read("casos").first(), read("candidatos").first()
    from datetime import datetime
    decisions = spark.createDataFrame([(case.id, option.linha_id, "ana", datetime(2026, 7, 22)),
                                       (5, None, "ana", datetime(2026, 7, 22))], schema.DECISOES)
    assert runs.decide(spark, root, decisions).count() == 1
    assert read("casos").first().resolucao == f"linha_id={option.linha_id}"
    assert read("reconciliacoes").where("tipo_match = 'exato'").count() == 2
    assert read("linhas").where("pago = -45").count() == 2 and read("linhas").count() == 4
    assert read("casos").count() == 1 and read("reconciliacoes").count() == 3


def test_stopped_run_is_completed_by_the_next(spark, ledger):
    """Reconciliations were stored but the lines were not paid yet."""
    root, _ = ledger
    c = cells(spark, {f"/{FOLDER}/21-07-2026_Ancora Apogeu.xlsx": statement([("Renda", Decimal("-45.00"))], "21-07-2026")})
    ingest.import_movements(root, c)
    ingest.import_plan(root, cells(spark, {ingest.plan_file("", DIA): xlsx({"21": PLAN})}))
    read = lambda t: schema.read_table(spark, root, t)
    from bankrec.operators import reconcile
    run = reconcile.classify(read("movimentos"), read("linhas"))
    schema.write_table(reconcile.reconciliations(run), root, "reconciliacoes")
    runs.reconcile_days(spark, root)
    assert read("linhas").where("pago = -45").count() == 1 and read("reconciliacoes").count() == 1


def test_stream_reads_each_file_once(spark, ledger, tmp_path):
    root, docs = ledger
    check = str(tmp_path / "ponto")
    put(docs, "21-07-2026_A.xlsx", xlsx({"F": SHEET}))
    put(docs, "21-07-2026_B.xlsx", xlsx({"F": SHEET}))

    def run():
        q = imports.stream_movements(spark, str(docs), root, check)
        q.awaitTermination(120)
        assert q.exception() is None
        return schema.read_table(spark, root, "movimentos")

    assert run().count() == 2
    put(docs, "21-07-2026_C.xlsx", xlsx({"F": SHEET}))
    run()
    rows = run().collect()
    assert sorted(r.empresa for r in rows) == ["A", "B", "C"] and len({r.id for r in rows}) == 3
    # a batch that is run again replaces its own rows
    again = workbook.files(spark, str(docs)).where("path like '%_C.xlsx'")
    imports.import_batch(root, again, 1)
    assert schema.read_table(spark, root, "movimentos").count() == 3


def test_recorded_runs_get_ids(spark, ledger):
    from datetime import datetime
    root, _ = ledger
    rows = [(None, " Preencher ", "ok", None, None, 1.0, datetime(2026, 8, 19, 9, 0, i % 2)) for i in range(4)]
    df = spark.createDataFrame(rows, schema.EXECUCOES).drop("id")
    runs.record(spark, root, df)
    runs.record(spark, root, df)
    stored = schema.read_table(spark, root, "execucoes").collect()
    assert len({r.id for r in stored}) == 8 and {r.script for r in stored} == {"preencher"}


def test_days_with_nothing_pending_are_told(spark, ledger):
    root, _ = ledger
    c = cells(spark, {f"/{FOLDER}/21-07-2026_Ancora Apogeu.xlsx": statement([("Renda", Decimal("-45.00"))], "21-07-2026")})
    ingest.import_movements(root, c)
    days = [DIA, date(2026, 7, 22)]
    got = [{r.dia: (r.casados, r.novos, r.ambiguos) for r in runs.reconcile_days(spark, root, days).collect()} for _ in range(2)]
    assert got == [{days[0]: (0, 1, 0), days[1]: (0, 0, 0)}, {d: (0, 0, 0) for d in days}]


def test_runs_are_stored_by_day(spark, ledger):
    from datetime import datetime
    root, _ = ledger
    rows = [(None, "a", "ok", None, None, 1.0, datetime(2026, 8, d, 9)) for d in (1, 1, 2)]
    runs.record(spark, root, spark.createDataFrame(rows, schema.EXECUCOES).drop("id"))
    one = schema.read_table(spark, root, "execucoes", [date(2026, 8, 2)])
    assert one.count() == 1 and "PartitionFilters: [isnotnull(dia" in one._jdf.queryExecution().executedPlan().toString()


def test_files_come_whole_from_rows_of_any_batch(spark):
    """Files are rendered from a stream of rows, not from a group of rows each."""
    from pyspark.sql import functions as F
    from bankrec.plans import workbooks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        base = spark.range(60).select("id", F.lit(DIA).alias("dia"), F.concat(F.lit("E"), F.col("id") % 3).alias("empresa"))
        moved = base.select("*", F.when(F.col("id") % 5 > 0, "x").alias("descricao"), F.col("id").cast("decimal(18,2)").alias("valor"))
        closing = spark.createDataFrame([(DIA, "E0", Decimal("5.00"), None)], "dia date, entidade string, saldo_contabilistico decimal(18,2), saldo_disponivel decimal(18,2)")
        files = workbooks.statement_files(moved, closing, "raiz")
        assert files.count() == 3 and "FlatMapGroups" not in files._jdf.queryExecution().toString()
        c = workbook.cells(files)
        got = statements.statement_movements(c).groupBy("empresa").agg(F.sum("valor").alias("v"), F.count_if(F.col("descricao") == "").alias("n")).collect()
        assert {(r.empresa, r.v, r.n) for r in got} == {(f"E{k}", money(sum(range(k, 60, 3))), 4) for k in range(3)}
        assert {(r.entidade, r.saldo_contabilistico, r.saldo_disponivel) for r in statements.statement_balances(c).collect()} == {
            ("E0", money(5), None), ("E1", None, None), ("E2", None, None)}
        lines = base.select("*", F.when(F.col("id") % 2 == 0, "recebimento").otherwise("pagamento").alias("tipo"),
                            F.col("id").cast("decimal(18,2)").alias("previsto"), F.lit(None).cast("decimal(18,2)").alias("pago"), F.lit("I").alias("imputacao"))
        plans = workbooks.plan_files(lines, "raiz")
        assert "FlatMapGroups" not in plans._jdf.queryExecution().toString()
        back = plan_sheet.plan_lines(workbook.cells(plans)).groupBy("tipo").agg(F.count("*").alias("n"), F.sum("previsto").alias("v")).collect()
        assert {(r.tipo, r.n, r.v) for r in back} == {("recebimento", 30, money(870)), ("pagamento", 30, money(-900))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_sheets_are_read_as_a_stream(spark, monkeypatch):
    content = xlsx({"F": {**SHEET, "E6": 2.5}})
    whole = list(workbook._read("p", content))
    monkeypatch.setattr(workbook, "_SMALL_SHEET", 0)
    assert list(workbook._read("p", content)) == whole and len(whole) == 10


def test_statements_are_parsed_once_for_the_numbers(spark, ledger, monkeypatch):
    """Rows that get ids are read twice, so they are written down first."""
    root, _ = ledger
    c = cells(spark, {f"/{FOLDER}/21-07-2026_A.xlsx": xlsx({"F": SHEET})}).checkpoint()
    plans, real = [], ingest.assign_ids
    monkeypatch.setattr(ingest, "assign_ids", lambda rows, *more: plans.append(rows._jdf.queryExecution().analyzed().toString()) or real(rows, *more))
    ingest.import_movements(root, c, [DIA])
    ingest.import_balances(root, c)
    ingest.refresh_balances(root, c, DIA)
    assert len(plans) == 3 and not any("Aggregate" in p or "Join" in p for p in plans)
