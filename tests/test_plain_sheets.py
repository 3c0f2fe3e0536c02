"""Sheets and archives that are read without the parser and the library hold the same cells."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from bankrec.plans.workbooks import _workbook, statement, xlsx
from bankrec.sources import workbook
from bankrec.sources.paths import file_name, statement_day
from conftest import money

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def parsed(content):
    """Cells by the library and the parser alone."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(workbook, "_directory", lambda content: None)
        m.setattr(workbook, "_plain_cells", lambda sheet: None)
        return told(content)


def told(content):
    try:
        return [*workbook._read("p", content)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as error:
        return f"{type(error).__name__}: {error}"


def with_sheet(sheet):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx({"F": {"A1": "x"}}))) as given, zipfile.ZipFile(out, "w") as z:
        for name in given.namelist():
            z.writestr(name, sheet if name.endswith("sheet1.xml") else given.read(name))
    return out.getvalue()


BODIES = {
    '<row r="1"><c r="A1" t="inlineStr"><is><t>a &amp;amp; b &lt;c&gt;</t></is></c><c r="B1" s="3"><v>1.50</v></c></row>': True,
    '<row r="1" spans="1:2"><c r="A1" t="str"><f>A2&amp;"x"</f><v>q</v></c><c r="B1" t="b"><v>1</v></c></row>': True,
    '<row r="1"><c r="A1"/><c r="C1"><f>1+1</f></c></row><row r="2"/><row r="7"><c r="ZZ7" t="e"><v>#N/A</v></c></row>': True,
    '<row r="1"><c r="A1" t="inlineStr"><is><t xml:space="preserve"></t></is></c></row>': True,
    '<row r="1"><c r="A1"><v>x</v></c></row>': True,
    "": True,
    '<row r="1"><c r="A1"><v></v></c><c r="B1"><v>2</v></c></row>': False,
    '<row r="1"><c><v>1</v></c><c><v>2</v></c></row>': False,
    '<row r="1">\n<c r="A1"><v>1</v></c></row>': False,
    '<row r="1"><c r="A1" t="inlineStr"><is><t>a&#10;b\r\nc</t></is></c></row>': False,
    '<row r="1"><c r="A1" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>': False,
    '<row r="1"><c r="A1"><v>1</v></c>': False,
    '<row r="1"><row r="2"><c r="A2"><v>1</v></c></row></row>': False,
    '<c r="A1"><v>1</v></c>': False,
    '<row r="1"><c r="A1"><v>]]></v></c></row>': False,
    '<row r="1" r="1"><c r="A1"><v>1</v></c></row>': False,
    '<row r="1"><c r="A1"><v>\x01</v></c></row>': False,
}


@pytest.mark.parametrize("body", BODIES)
def test_plain_sheets_are_read_as_parsed(body):
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet {NS}><sheetData>{body}</sheetData><a b="1"/></worksheet>'
    assert (workbook._plain_cells(sheet.encode()) is not None) is BODIES[body]
    assert told(with_sheet(sheet)) == parsed(with_sheet(sheet))


@pytest.mark.parametrize("sheet", [
    f"<worksheet {NS}><!-- <sheetData><row r=\"1\"><c r=\"A1\"><v>1</v></c></row></sheetData> --></worksheet>",
    f"<worksheet {NS}><sheetData></sheetData><sheetData><row r=\"1\"><c r=\"A1\"><v>1</v></c></row></sheetData></worksheet>",
    f"<worksheet {NS}><sheetData></sheetData>", f"<worksheet {NS}><sheetData/></worksheet>", "", "nada",
    '<?xml version="1.0" encoding="ISO-8859-1"?><worksheet><sheetData><row r="1"><c r="A1" t="str"><v>é</v></c></row></sheetData></worksheet>',
])
def test_sheets_left_to_the_parser(sheet):
    assert workbook._plain_cells(sheet.encode()) is None
    assert told(with_sheet(sheet)) == parsed(with_sheet(sheet))


def test_archives_cut_or_changed_at_any_place_are_read_as_by_the_library():
    content = statement([("x", money(1))], "21-07-2026", money(5))
    assert workbook._directory(content) is not None and told(content) == parsed(content)
    for at in range(0, len(content), 7):
        for odd in (content[:at], content[at:], content[:at] + bytes([content[at] ^ 0x55]) + content[at + 1:], content + content[:at]):
            known = workbook._directory(odd)
            try:
                with zipfile.ZipFile(io.BytesIO(odd)) as z:
                    there = {i.filename: (i.header_offset, i.flag_bits, i.compress_type, i.CRC, i.compress_size, i.file_size)
                             for i in z.filelist}
            except (zipfile.BadZipFile, NotImplementedError, UnicodeDecodeError, ValueError):
                there = None
            assert known is None or known == there


def test_archives_hold_what_the_library_would_write():
    with zipfile.ZipFile(io.BytesIO(_workbook({"F": ["<row/>"], "é": []}))) as z:
        assert z.testzip() is None
        sheet = z.getinfo("xl/worksheets/sheet1.xml")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as again:
            for part in z.filelist:
                info = zipfile.ZipInfo(part.filename, part.date_time)
                again.writestr(info, z.read(part))
        assert (sheet.date_time, z.namelist()[-2:]) == ((1980, 1, 1, 0, 0, 0), ["xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"])
    assert out.getvalue() == _workbook({"F": ["<row/>"], "é": []})


def test_days_and_names_of_odd_paths(spark):
    paths = ["/a/21-07-2026/x.xlsx", "21-07-2026/x.xlsx", "/21-07-2026/x", "/a/21-07-2026/", "/a/121-07-2026/x", "/a/31-02-2026/x",
             "/a/21-07-2026/b/x", "x", "", None, "/21-07-2026//x", "/01-01-0000/x"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(
        statement_day("path").cast("string").alias("dia"), file_name("path").alias("nome")).collect()
    day = "2026-07-21"
    assert [r.dia for r in rows] == [day, None, day, None, None, None, None, None, None, None, None, "0000-01-01"]
    assert [r.nome for r in rows] == ["x.xlsx", "x.xlsx", "x", "", "x", "x", "x", "x", "", None, "x", "x"]
