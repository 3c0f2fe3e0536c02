"""Statements are brought together by file once, and files of unusual archives are read alike."""

import io
import zipfile

import pytest

from bankrec.plans.workbooks import statement, xlsx
from bankrec.sources import statements, workbook
from conftest import money

FOLDER = "/d/FINANCEIRO/07_Julho/21-07-2026"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def cells(spark, files):
    return workbook.cells(spark.createDataFrame(list(files.items()), "path string, content binary"))


def test_movements_need_one_shuffle(spark):
    c = cells(spark, {f"{FOLDER}/21-07-2026_A.xlsx": statement([("x", money(1)), ("y", money(-2))], "21-07-2026", money(5))})
    assert exchanges(statements.statement_movements(c)) == 1
    assert exchanges(statements.rejected(c)) == 1
    assert statements.statement_movements(c).count() == 2


def test_files_without_a_path_have_no_movements(spark):
    c = cells(spark, {None: statement([("x", money(1))], "21-07-2026", money(5))})
    assert statements.statement_movements(c).count() == 0 and statements.rejected(c).count() == 0
    assert [(r.dia, r.entidade, r.saldo_contabilistico) for r in statements.statement_balances(c).collect()] == [(None, None, None)]


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_parts_of_archives(kind):
    plain, out = xlsx({"F": {"A1": "x", "B2": 3}, "G": {"A1": "y"}}), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as given, zipfile.ZipFile(out, "w", kind) as z:
        assert given.testzip() is None
        for name in given.namelist():
            z.writestr(name, given.read(name))
    assert [*workbook._read("p", out.getvalue())] == [*workbook._read("p", plain)]
    assert [c[1:6] for c in workbook._read("p", plain)] == [("F", True, 1, "A", "text"), ("F", True, 2, "B", "number"), ("G", False, 1, "A", "text")]


def test_a_damaged_part_is_an_error():
    content = bytearray(xlsx({"F": {"A1": "abcdef"}}))
    content[bytes(content).index(b"abcdef")] ^= 1
    with pytest.raises(zipfile.BadZipFile):
        list(workbook._read("p", bytes(content)))
