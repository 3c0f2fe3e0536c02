"""Workbooks rendered from ledger rows, for the import queries and the tests."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections import namedtuple
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import lru_cache
from itertools import chain, groupby
from operator import attrgetter
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.session import task_count
from bankrec.sources.paths import plan_path, statement_folder

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_BLOCK = 1 << 15                                 # rows of one file, at most
_FILES = "path string, content binary"
_FILES_PER_BATCH = 500
_EURO_SIGNS = str.maketrans(",.", ".,")
# headers of a stored part of 1980-01-01 and the end of an archive, as ``zipfile`` writes them
_LOCAL, _CENTRAL, _END = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
_DATE, _VERSION, _MODE = 33, 20, 0o600 << 16


def _inside(value) -> str:
    """A cell after its place."""
    if isinstance(value, str):
        if value.startswith("="):
            return f'"><f>{escape(value[1:])}</f></c>'
    elif isinstance(value, (int, float, Decimal)):
        return f'"><v>{value}</v></c>'
    return f'" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _cell(ref: str, value) -> str:
    return f'<c r="{ref}{_inside(value)}'


def _row(row: int, cells: list[tuple[str, object]]) -> str:
    """A row of ``(column, value)`` in column order; null values have no cell."""
    body = "".join(_cell(f"{column}{row}", value) for column, value in cells if value is not None)
    return f'<row r="{row}">{body}</row>' if body else ""


@lru_cache(maxsize=256)
def _frame(names: tuple[str, ...]) -> tuple[bytes, bytes, int]:
    """The parts of a workbook that follow from the names of its sheets, their entries in its
    directory, and how many they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml",
                   f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}/relationships">' + "".join(
            f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" '
                   f'Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PKG}/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/></Types>')
        begin = out.getvalue()
    return begin, out.getvalue()[len(begin):-struct.calcsize(_END)], len(z.filelist)


def _workbook(sheets: dict[str, Iterable[str]]) -> bytes:
    """A workbook from the rows of its sheets. The parts that are the same in many files are
    written once; the library takes longer for its records than the sheets themselves."""
    begin, directory, count = _frame(tuple(sheets))
    out, entries, at = [begin], [directory], len(begin)
    for i, rows in enumerate(sheets.values(), 1):
        name = b"xl/worksheets/sheet%d.xml" % i
        part = f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(rows)}</sheetData></worksheet>'.encode()
        crc, size = zlib.crc32(part), len(part)
        out += struct.pack(_LOCAL, b"PK\3\4", _VERSION, 0, 0, 0, _DATE, crc, size, size, len(name), 0), name, part
        # made on Unix
        entries += struct.pack(_CENTRAL, b"PK\1\2", 3 << 8 | _VERSION, _VERSION, 0, 0, 0, _DATE, crc, size, size,
                                 len(name), 0, 0, 0, 0, _MODE, at), name
        at += struct.calcsize(_LOCAL) + len(name) + size
    places = b"".join(entries)
    count += len(sheets)
    return b"".join([*out, places, struct.pack(_END, b"PK\5\6", 0, 0, count, count, len(places), at, 0)])


def xlsx(sheets: dict[str, dict[str, object]]) -> bytes:
    """A workbook from ``{sheet: {"A1": value}}``; text that starts with ``=`` is a formula."""
    def place(ref: str) -> tuple[int, int, str]:
        letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
        return int(digits), len(letters), letters

    def rows(cells: dict[str, object]) -> Iterator[str]:
        placed = sorted((place(ref), ref) for ref in cells)
        for row, own in groupby(placed, key=lambda x: x[0][0]):
            yield _row(row, [(at[2], cells[ref]) for at, ref in own])

    return _workbook({name: rows(cells) for name, cells in sheets.items()})


def euros(value: Decimal) -> str:
    """``1.234,56``"""
    return f"{value:,.2f}".translate(_EURO_SIGNS)


def statement(rows: list[tuple[str, Decimal]], dia: str, contabilistico=None, disponivel=None) -> bytes:
    told = lambda v: None if v is None else euros(v) + " EUR"
    top = [_row(r, [("A", label), ("B", told(v))]) for r, label, v in (
        (1, "Saldo contabilístico", contabilistico), (2, "Saldo disponível", disponivel)) if v is not None]
    day = None if dia is None else _inside(dia)

    def line(r: int, text: str, value: Decimal) -> str:
        days = "" if day is None else f'<c r="A{r}{day}<c r="B{r}{day}'
        told = "" if text is None else f'<c r="C{r}{_inside(text)}'
        return f'<row r="{r}">{days}{told}<c r="D{r}{_inside(euros(value))}</row>'

    body = (line(r, text, value) for r, (text, value) in enumerate(rows, 6))
    return _workbook({"Movimentos": chain(top, [_row(5, [("A", "Data mov.")])], body)})


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from map(namedtuple("Row", b.schema.names)._make, zip(*(c.to_pylist() for c in b.columns)))


def _files_of(batches: Iterator[pa.RecordBatch], keys: list[str], content) -> Iterator[pa.RecordBatch]:
    """``(path, content)`` of files whose rows follow each other, by ``content`` of a file's rows.
    Holds one file's rows and a few hundred files."""
    batch = lambda done: pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array(
        [c for _, c in done], pa.binary())], ["path", "content"])
    done: list[tuple[str, bytes]] = []
    for _, own in groupby(_rows_of(batches), key=attrgetter(*keys)):
        lines = list(own)
        done.append((lines[0].path, content(lines)))
        if len(done) == _FILES_PER_BATCH:
            yield batch(done)
            done = []
    if done:
        yield batch(done)


def _statement_content(rows: list[tuple]) -> bytes:
    first = rows[0]
    return statement([(r.descricao, r.valor) for r in rows], first.dia_texto,
                     first.saldo_contabilistico, first.saldo_disponivel)


def _statement_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _files_of(batches, ["path"], _statement_content)


def statement_files(movimentos: DataFrame, saldos: DataFrame, root: str) -> DataFrame:
    """``(path, content)``: the statements of each company and day, with the day's
    closing balances. A file holds one block of ids, so its size is bounded."""
    block = F.floor(F.col("id") / _BLOCK)
    path = F.concat(F.lit("bloco-"), block.cast("string"), F.lit("/"), statement_folder(root, "dia"), F.lit("/"), F.date_format("dia", "dd-MM-yyyy"),
                    F.lit("_"), F.col("empresa"), F.lit(".xlsx"))
    closing = saldos.select("dia", F.col("entidade").alias("empresa"), "saldo_contabilistico",
                            "saldo_disponivel")
    rows = (movimentos.join(closing, ["dia", "empresa"], "left")
            .select("id", "descricao", "valor", "saldo_contabilistico", "saldo_disponivel",
                    F.date_format("dia", "dd-MM-yyyy").alias("dia_texto"), path.alias("path")))
    return (rows.repartition(task_count(rows.sparkSession), "path").sortWithinPartitions("path", "id")
            .mapInArrow(_statement_files, _FILES))


def _plan_content(lines: list[tuple]) -> bytes:
    def row(r: int, line: tuple) -> str:
        planned, paid, company, use = ("C", "D", "E", "F") if line.sinal > 0 else ("I", "J", "K", "L")
        size = lambda v: None if v is None else abs(v)
        return _row(r, [(planned, size(line.previsto)), (paid, size(line.pago)), (company, line.empresa),
                        (use, line.imputacao)])

    end = 5 + len(lines)
    body = [row(r, line) for r, line in enumerate(lines, 5)]
    return _workbook({lines[0].folha: [_row(4, [("A", "Nº")]), *body, _row(end, [("A", f"=SUM(C5:C{end - 1})")])]})


def _plan_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _files_of(batches, ["path", "folha"], _plan_content)


def plan_files(linhas: DataFrame, root: str) -> DataFrame:
    """``(path, content)``: plan workbooks with the sheet of one day each."""
    block = F.floor(F.col("id") / _BLOCK).cast("string")
    path = F.concat(F.lit("bloco-"), block, F.lit("/"), plan_path(root, "dia"))
    rows = linhas.select(
        "id", "empresa", "previsto", "pago", "imputacao",
        F.when(F.col("tipo") == "recebimento", 1).otherwise(-1).alias("sinal"),
        path.alias("path"), F.date_format("dia", "dd").alias("folha"))
    return (rows.repartition(task_count(rows.sparkSession), "path", "folha").sortWithinPartitions("path", "folha", "id")
            .mapInArrow(_plan_files, _FILES))
