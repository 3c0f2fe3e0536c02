"""Workbook cells as rows.

Spark has no reader for ``.xlsx`` files, so this is the one file format read by
hand: each file is opened inside a task and its cells are emitted one per row.
Everything after that is DataFrame work on cells.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bankrec.schema import CELULAS

_SCHEMA = StructType(CELULAS.fields).add("erro", "string")
_ROWS_PER_BATCH = 20_000
_SMALL_SHEET = 4 << 20                           # bytes of a sheet that is parsed at once
_UNUSUAL = 0x1 | 0x20 | 0x40 | 0x2000            # encrypted or patched parts of an archive
_REF = re.compile(r"([A-Z]+)(\d+)")
_CENTRAL, _CENTRAL_SIZE = "<4s6H3L5H2L", 46       # an entry of an archive's directory
_END, _END_SIZE = "<4s4H2LH", 22                 # and what stands behind it
_NEWEST = 63                                     # version of archives that the library reads
# rows and cells as most writers put them; whatever else a sheet holds is left to the parser
_CHARS = r"(?:[^<>&\x00-\x1f\ufffe\uffff]|&(?:amp|lt|gt);)"
_TOKEN = re.compile(
    r'<c r="([A-Z]+)([0-9]+)"(?: s="[0-9]+")?(?: t="([A-Za-z]+)")?(?:/>|>'
    rf'(?:<f>({_CHARS}+)</f>)?(?:<v>({_CHARS}+)</v>)?(?:<is><t(?: xml:space="preserve")?>({_CHARS}*)</t></is>)?</c>)'
    r'|(<row r="[0-9]+"(?: spans="[0-9:]+")?/?>|</row>)')
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of every workbook under a folder."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
            .option("recursiveFileLookup", "true").load(folder).select("path", "content"))


@lru_cache(maxsize=1024)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    """Text of a cell or shared string, without phonetic hints."""
    if len(node) == 1 and _local(node[0].tag) == "t":
        return node[0].text or ""
    parts = [t.text or "" for t in node if _local(t.tag) == "t"]
    for run in node:
        if _local(run.tag) == "r":
            parts += [t.text or "" for t in run if _local(t.tag) == "t"]
    return "".join(parts)


@lru_cache(maxsize=256)
def _sheets(rels_part: bytes, book_part: bytes) -> list[tuple[str, str]]:
    """Sheet names and their files, in workbook order. Many files have the same parts."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(rels_part)}
    book = ElementTree.fromstring(book_part)
    found = []
    for node in book.iter():
        if _local(node.tag) == "sheet":
            target = rels[node.get(_REL)]
            found.append((node.get("name"), target.lstrip("/") if target.startswith("/")
                          else "xl/" + target))
    return found


def _told(kind: str, value: str | None, formula: str | None, inline: str | None, shared: list[str]):
    if kind == "inlineStr":
        return "text", inline, None, formula
    if kind == "s" and value is not None:
        return "text", shared[int(value)], None, formula
    if kind in ("str", "e"):
        return "text", value, None, formula
    if kind == "b":
        return "bool", value, None, formula
    if value is None:
        return ("formula", None, None, formula) if formula else None
    return "number", None, float(value), formula


def _cell(node, shared: list[str]):
    value, formula, inline = None, None, None
    for child in node:
        tag = _local(child.tag)
        if tag == "v":
            value = child.text
        elif tag == "f":
            formula = "=" + (child.text or "")
        elif tag == "is":
            inline = _texts(child)
    return _told(node.get("t", "n"), value, formula, inline, shared)


@lru_cache(maxsize=256)
def _plain_frame(before: str, behind: str) -> bool:
    """Whether what surrounds the rows of a sheet is well formed and holds none. Many files
    have the same parts."""
    if "<!DOCTYPE" in before or ("encoding=" in before and 'encoding="utf-8"' not in before.lower()):
        return False
    try:
        sheet = ElementTree.fromstring(f"{before}<sheetData/>{behind}".encode())
    except ElementTree.ParseError:
        return False
    names = [_local(node.tag) for node in sheet.iter()]
    return [_local(node.tag) for node in sheet].count("sheetData") == names.count("sheetData") == 1 and "row" not in names


def _plain_cells(sheet: bytes) -> list[tuple] | None:
    """``(row, column, kind, value, formula, inline)`` of the cells of a plainly written sheet, or
    none where the parser has to look. Every character is accounted for."""
    try:
        text = sheet.decode()
    except UnicodeDecodeError:
        return None
    before, _, rest = text.partition("<sheetData>")
    end = rest.find("</sheetData>")
    if end < 0 or not _plain_frame(before, rest[end + len("</sheetData>"):]):
        return None
    found, at, inside = [], 0, False
    for match in _TOKEN.finditer(rest, 0, end):
        if match.start() != at:
            return None
        at = match.end()
        column, row, kind, formula, value, inline, edge = match.groups()
        if edge is not None:
            if inside is not (edge == "</row>"):
                return None
            inside = edge[-2] != "/" and not inside
        elif not inside:
            return None
        else:
            found.append((int(row), column, kind or "n", value, formula, inline))
    if at != end or inside:
        return None
    if "&" in rest:
        plain = lambda told: told and unescape(told)
        found = [(row, column, kind, *map(plain, told)) for row, column, kind, *told in found]
    return found


@lru_cache(maxsize=1 << 16)
def _place(ref: str | None) -> tuple[str, int] | None:
    found = _REF.fullmatch(ref or "")
    return found and (found.group(1), int(found.group(2)))


class _Part(NamedTuple):
    header_offset: int
    flag_bits: int
    compress_type: int
    CRC: int
    compress_size: int
    file_size: int


def _directory(content: bytes) -> dict[str, _Part] | None:
    """The parts of a plainly written archive by name; none where the library has to look."""
    end = len(content) - _END_SIZE
    if end < 0 or content[end:end + 4] != b"PK\5\6" or content[max(0, end - 20):end][:4] == b"PK\6\7":
        return None
    *_, size, at, comment = struct.unpack_from(_END, content, end)
    if at + size != end or comment:
        return None
    parts = {}
    while at + _CENTRAL_SIZE <= end:
        (sign, _, version, flags, kind, _, _, crc, packed, whole, named, extra, noted, _, _, _,
         begin) = struct.unpack_from(_CENTRAL, content, at)
        at += _CENTRAL_SIZE
        name = content[at:at + named]
        at += named + noted
        if (sign != b"PK\1\2" or version & 0xFF > _NEWEST or extra or not name.isascii() or b"\0" in name
                or 0xFFFFFFFF in (packed, whole, begin)):
            return None
        parts[name.decode("ascii")] = _Part(begin, flags, kind, crc, packed, whole)
    return parts if at == end else None


class _Archive:
    """The parts of a workbook. Opening small archives with the library takes longer than reading
    their cells, so it reads only those that are not plainly written, or not as announced."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self._known = _directory(content)
        self._opened = None
        self.parts = self.library().NameToInfo if self._known is None else self._known

    def library(self) -> zipfile.ZipFile:
        if self._opened is None:
            self._opened = zipfile.ZipFile(io.BytesIO(self.content))
        return self._opened

    def getinfo(self, name: str):
        return self.parts.get(name) or self.library().getinfo(name)

    def read(self, name: str) -> bytes:
        """A part, without the library where it is plainly stored or deflated."""
        info, content = self.getinfo(name), self.content
        at = info.header_offset
        if info.flag_bits & _UNUSUAL or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or at + 30 > len(content):
            return self.library().read(name)
        begin = at + 30 + int.from_bytes(content[at + 26:at + 28], "little") + int.from_bytes(content[at + 28:at + 30], "little")
        part = content[begin:begin + info.compress_size]
        try:
            part = part if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(part, -zlib.MAX_WBITS)
        except zlib.error:
            return self.library().read(name)
        # what is not as announced is left to the library, which knows why
        return part if zlib.crc32(part) == info.CRC and len(part) == info.file_size else self.library().read(name)


def _rows(archive: _Archive, member: str, sheet: bytes | None) -> Iterator[ElementTree.Element]:
    """The rows of a sheet. Small sheets are parsed at once, which is several times faster;
    large ones as a stream."""
    if sheet is not None:
        yield from [node for node in ElementTree.fromstring(sheet).iter()
                    if node.tag.endswith("row") and _local(node.tag) == "row"]
        return
    with archive.library().open(member) as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) == "row":
                yield node
                node.clear()


def _sheet_cells(archive: _Archive, member: str, shared: list[str]) -> Iterator[tuple]:
    """``(row, column, kind, text, number, formula)`` of the cells of a sheet."""
    sheet = archive.read(member) if archive.getinfo(member).file_size <= _SMALL_SHEET else None
    plain = None if sheet is None else _plain_cells(sheet)
    if plain is not None:
        for row, column, kind, value, formula, inline in plain:
            cell = _told(kind, value, formula and "=" + formula, inline, shared)
            if cell is not None:
                yield row, column, *cell
        return
    for node in _rows(archive, member, sheet):
        at = -1
        for c in node:
            if _local(c.tag) != "c":
                continue
            at += 1
            cell = _cell(c, shared)
            if cell is None:
                continue
            column, row = _place(c.get("r")) or (chr(ord("A") + at), int(node.get("r")))
            yield row, column, *cell


def _read(path: str, content: bytes) -> Iterator[tuple]:
    archive = _Archive(content)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.parts:
        shared = [_texts(n) for n in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
    sheets = _sheets(*(archive.read(name) for name in ("xl/_rels/workbook.xml.rels", "xl/workbook.xml")))
    for number, (sheet, member) in enumerate(sheets):
        for cell in _sheet_cells(archive, member, shared):
            yield path, sheet, number == 0, *cell, None


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_SCHEMA)
    rows: list[tuple] = []

    def batch(some: list[tuple]) -> pa.RecordBatch:
        # a number that is none is null
        return pa.RecordBatch.from_arrays([pa.array(column, field.type, from_pandas=True)
                                           for column, field in zip(zip(*some), schema)], schema=schema)

    for given in batches:
        for path, content in zip(given.column("path").to_pylist(), given.column("content").to_pylist()):
            try:
                rows.extend(list(_read(path, content)))    # a file counts whole or not at all
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as error:
                rows.append((path, *[None] * (len(schema) - 2), f"{type(error).__name__}: {error}"))
            while len(rows) >= _ROWS_PER_BATCH:
                yield batch(rows[:_ROWS_PER_BATCH])
                rows = rows[_ROWS_PER_BATCH:]
    if rows:
        yield batch(rows)


def cells(ficheiros: DataFrame) -> DataFrame:
    """Cells of ``(path, content)`` workbooks, with cached value and formula. A file
    that cannot be read gives one row that holds only ``path`` and ``erro``."""
    return ficheiros.select("path", "content").mapInArrow(_read_batches, _SCHEMA)


def unreadable(celulas: DataFrame) -> DataFrame:
    return celulas.where("erro is not null").select("path", F.col("erro").alias("motivo"))
