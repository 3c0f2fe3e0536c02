from datetime import datetime

import pytest

from bankrec import schema
from bankrec.operators import monitoring, reports
from bankrec.sources import logs


def runs(spark, rows):
    return spark.createDataFrame([(i, s, st, e, log, 1.0, ts) for i, (s, st, e, log, ts) in enumerate(rows, 1)],
                                 schema.EXECUCOES)


@pytest.mark.parametrize("now,last,late,missing", [
    ((13, 5), (7, 55), False, None),
    ((13, 15), None, True, "12:50"),
    ((13, 15), (11, 55), False, None),
    ((8, 0), None, False, None),
])
def test_overdue_in_summer_time(spark, now, last, late, missing):
    """Local time is one hour ahead of UTC."""
    scripts = spark.createDataFrame([("s", "08:50, 12:50, 14:10, 25:00, lixo,")], "nome string, hora_execucao string")
    last_run = spark.createDataFrame([("s", datetime(2026, 8, 19, *last))] if last else [], "nome string, ts timestamp")
    r = monitoring.overdue(scripts, last_run, datetime(2026, 8, 19, now[0] - 1, now[1])).first()
    assert (r.atrasado, r.hora_em_falta) == (late, missing)


def test_known_scripts_are_always_listed(spark):
    status = monitoring.script_status(runs(spark, [("Outro", "erro", "falhou", ["a", "b"], datetime(2026, 8, 19, 9))]),
                                      datetime(2026, 8, 19, 6))
    got = {r.nome: r for r in reports.status_badge(status).collect()}
    assert set(got) == {"preencher_mapa", "atualizar_mapa_saldos", "enviar_mapa_smtp", "Outro"}
    assert got["Outro"].ultima_execucao == "2026-08-19T09:00:00Z" and got["Outro"].status_badge == "❌ Erro"
    assert got["Outro"].descricao == "Script Outro" and got["preencher_mapa"].status == "ok"


def test_recent_runs(spark):
    df = runs(spark, [("a", "ok", None, None, datetime(2026, 8, 19, 9)), ("b", "erro", "x", ["l1", "l2"], datetime(2026, 8, 19, 10)),
                      ("A", "warning", "", [], datetime(2026, 8, 19, 11))])
    rows = monitoring.recent_runs(df, 2).collect()
    assert [(r.script, r.nivel) for r in rows] == [("b", "erro"), ("A", "info")]
    assert rows[0].detalhe == ["l1", "l2"] and rows[1].mensagem == "Execução do script A registada com status warning."
    assert [r.id for r in monitoring.runs_of(df, "a").collect()] == [1, 3]
    # the limit comes before the filter
    assert [r.id for r in monitoring.runs_of(df, "a", 2).collect()] == [3]


def test_recorded_runs_are_normalised(spark):
    r = monitoring.record_runs(runs(spark, [("  Preencher ", "ok", None, None, datetime(2026, 8, 19, 9))])).first()
    assert (r.script, r.log) == ("preencher", [])


def test_late_list(spark):
    status = monitoring.script_status(runs(spark, []), datetime(2026, 8, 19, 8, 30))
    assert monitoring.late_scripts(status).first().atrasados == "atualizar_mapa_saldos, preencher_mapa"


def test_log_lines(spark, tmp_path):
    day = tmp_path / "2026-08-19"
    day.mkdir()
    (day / "api.log").write_text("INFO ok\nValueError: x\nTRACEBACK y\nall fine\n")
    (day / "notes.txt").write_text("error\n")
    lines = logs.read(spark, str(tmp_path))
    got = logs.error_lines(lines).collect()
    assert [(str(r.dia), r.ficheiro, r.value) for r in got] == [
        ("2026-08-19", "api.log", "ValueError: x"), ("2026-08-19", "api.log", "TRACEBACK y")]
    out = tmp_path / "arquivo"
    logs.archive(lines, str(out))
    logs.archive(lines, str(out))
    assert list(out.glob("dia=2026-08-19/*.gz")) and spark.read.text(str(out)).count() == 4
