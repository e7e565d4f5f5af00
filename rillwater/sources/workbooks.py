"""Spreadsheet workbooks: the cells of one sheet of every file, as text.

A sheet holds at most 1,048,576 rows by its format, so one file is a bounded piece of work and files
are what is spread over the tasks. The bytes come through Spark's own file reader, so any store that
Spark reaches will do; a task streams the rows of a sheet and never holds the whole of it.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rillwater.sources.tables import text_schema

BATCH_ROWS = 5000
CHUNK_BYTES = 256 * 1024
FILE, LINE = "workbook", "sheet_row"
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_COLUMN = re.compile("[A-Z]+")

# Elements as writers of workbooks put them. They are cut out by expressions; what is written otherwise is left to the XML parser.
_LETTERS = r"[^<&\x00-\x08\x0b-\x1f\ufffe\uffff]*"
_TEXT = f"({_LETTERS}(?:&(?:amp|lt|gt|quot|apos);{_LETTERS})*)"
_STRING = re.compile(f'(<si><t(?: xml:space="preserve")?>{_TEXT}</t></si>)')
_ROW = re.compile(r'<row r="([0-9]+)"((?: [A-Za-z]+="[A-Za-z0-9.: ]*")*)>')
_CELL = re.compile(f'(<c r="([A-Z]+)[0-9]+"(?: s="[0-9]+")?(?: t="([a-z]+)")?(?:/>|>(?:<v>{_TEXT}</v>)?</c>))')
_ENCODING = re.compile(rb"""encoding\s*=\s*["'](?!utf-8["'])""", re.IGNORECASE)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    """Text of a string with its runs, without the reading aids beside it."""
    parts = []
    for child in element:
        if _local(child) == "t":
            parts.append(child.text or "")
        elif _local(child) == "r":
            parts += [t.text or "" for t in child if _local(t) == "t"]
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), "".join(parts))


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name, one after the other; what was read is let go."""
    with book.open(part) as stream:
        parents = []
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _local(element) == name:
                yield element
                if parents:
                    parents[-1].remove(element)


def _sheet_part(book: zipfile.ZipFile, sheet: str | None, file: str) -> str:
    """Where the sheet of that name, or the first one, lies in the file."""
    wanted = next((s for s in _elements(book, "xl/workbook.xml", "sheet") if sheet is None or s.get("name") == sheet), None)
    if wanted is None:
        raise ValueError(f"{file} has no sheet {sheet!r}")
    link = next(v for k, v in wanted.attrib.items() if k.endswith("}id"))
    target = next(r.get("Target") for r in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship") if r.get("Id") == link)
    return posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")


def _position(reference: str) -> int:
    """0-based column of a reference such as AB12."""
    at = 0
    for letter in _COLUMN.match(reference).group():
        at = at * 26 + ord(letter) - 64
    return at - 1


def _value(kind: str, value: str | None, shared: Sequence[str]) -> str | None:
    if not value or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), value) if kind == "str" else value


def _cell(cell: ElementTree.Element, shared: Sequence[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(c) for c in cell if _local(c) == "is"), None)
    return _value(kind, next((c.text for c in cell if _local(c) == "v"), None), shared)


class _Other(Exception):
    """A part is written otherwise than the expressions above read it."""


def _pieces(book: zipfile.ZipFile, part: str, opening: re.Pattern[bytes], name: str) -> Iterator[str]:
    """The inside of a part, cut behind ends of the elements of a name; around them there must be whole XML without any."""
    end = f"</{name}>".encode()
    with book.open(part) as stream:
        rest = stream.read(CHUNK_BYTES)
        start = opening.search(rest)
        head = rest[: start.end()] if start else b""
        if not start or b"<!" in head or head.rfind(b"<?") > 3 or _ENCODING.search(head):
            raise _Other
        rest = rest[start.end():]
        while True:
            cut = rest.rfind(end)
            if cut >= 0:
                try:
                    piece = rest[: cut + len(end)].decode()
                except UnicodeDecodeError as e:
                    raise _Other from e
                if "]]>" in piece:
                    raise _Other
                yield piece
                rest = rest[cut + len(end):]
            if not (chunk := stream.read(CHUNK_BYTES)):
                break
            rest += chunk
    try:
        around = ElementTree.fromstring(head + rest)
    except ElementTree.ParseError as e:
        raise _Other from e
    if any(_local(e) == name for e in around.iter()):
        raise _Other


def _plain(text: str) -> str:
    return unescape(text, {"&quot;": '"', "&apos;": "'"}) if "&" in text else text


def _plain_strings(book: zipfile.ZipFile, part: str) -> Iterator[str]:
    for piece in _pieces(book, part, re.compile(rb"<sst(?: [^<>]*[^<>/])?>"), "si"):
        found = _STRING.findall(piece)
        if sum(len(f[0]) for f in found) != len(piece):
            raise _Other
        for _, text in found:
            text = _plain(text)
            yield _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def _plain_rows(book: zipfile.ZipFile, part: str, shared: Sequence[str]) -> Iterator[tuple[int, list[str | None]]]:
    places: dict[str, int] = {}
    attributes = {""}
    for piece in _pieces(book, part, re.compile(rb"<sheetData>"), "row"):
        for row in piece.split("</row>")[:-1]:
            head = _ROW.match(row)
            if head is None:
                raise _Other
            if head[2] not in attributes:
                names = [a.partition("=")[0] for a in re.findall('[A-Za-z]+="', head[2])]
                if len({"r", *names}) <= len(names):
                    raise _Other
                attributes.add(head[2])
            found = _CELL.findall(row, head.end())
            if head.end() + sum(len(f[0]) for f in found) != len(row):
                raise _Other
            cells: list[str | None] = []
            for _, letters, kind, value in found:
                at = places.get(letters)
                if at is None:
                    at = places[letters] = _position(letters)
                if at >= len(cells):
                    cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(kind, _plain(value), shared)
            yield int(head[1]), cells


def _parsed_rows(book: zipfile.ZipFile, part: str, shared: Sequence[str]) -> Iterator[tuple[int, list[str | None]]]:
    number = 0
    for row in _elements(book, part, "row"):
        number = int(row.get("r", number + 1))
        cells: list[str | None] = []
        for cell in row:
            if _local(cell) != "c":
                continue
            at = _position(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            cells[at] = _cell(cell, shared)
        yield number, cells


def _either(plain: Iterator, parsed: Callable[[], Iterator]) -> Iterator:
    """What the expressions find, and from where they do not fit on, what the parser does."""
    n = 0
    try:
        for item in plain:
            yield item
            n += 1
        return
    except _Other:
        pass
    yield from itertools.islice(parsed(), n, None)


class _SharedStrings:
    """The shared strings of a book, read as far as they are asked for."""

    def __init__(self, book: zipfile.ZipFile) -> None:
        part = "xl/sharedStrings.xml"
        self.known: list[str] = []
        self.more = _either(_plain_strings(book, part), lambda: map(_text, _elements(book, part, "si"))) if part in book.namelist() else iter(())

    def __getitem__(self, i: int) -> str:
        self.known += itertools.islice(self.more, i + 1 - len(self.known) if i >= len(self.known) else 0)
        return self.known[i]

    def all(self) -> list[str]:
        self.known += self.more
        return self.known


def sheet_rows(content: bytes, sheet: str | None, file: str, head: bool = False) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of the rows that a sheet holds; gaps between cells are null.

    ``head`` is for who wants the first rows alone: then no more strings of the file are read than these rows take.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part = _sheet_part(book, sheet, file)
        strings = _SharedStrings(book)
        shared = strings if head else strings.all()
        yield from _either(_plain_rows(book, part, shared), lambda: _parsed_rows(book, part, shared))


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Names of a header row: ``unnamed_<n>`` for blank cells, a number behind repeated ones."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        name = (cell or "").strip() or f"unnamed_{i}"
        plain, n = name, 0
        while name in names:
            n += 1
            name = f"{plain}.{n}"
        names.append(name)
    return names


def workbook_headers(files: DataFrame, sheet: str | None = None) -> list[list[str]]:
    """The distinct header rows of (path, content) files, those of the first paths first."""
    def first_rows(batches):
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"]):
                row = next(sheet_rows(content, sheet, path, head=True), None)
                found.append((path, header_names(row[1]) if row else []))
            yield pd.DataFrame(found, columns=["path", "names"])

    schema = StructType([StructField("path", StringType()), StructField("names", ArrayType(StringType()))])
    heads = files.select("path", "content").mapInPandas(first_rows, schema).where("size(names) > 0")
    return [r["names"] for r in heads.groupBy("names").agg({"path": "min"}).orderBy("min(path)").collect()]


def workbook_rows(files: DataFrame, sheet: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """The rows below the header of every file, all text, with the file's path and the row number.

    ``files`` has the columns path and content. The header is the first row of a sheet, and columns are matched by name:
    files may order them differently, and a column that a file lacks is null there. Without ``names`` these are all
    names of all headers, which takes one more scan. Empty sheets and files without bytes give no rows; a file that is
    no workbook, or lacks the sheet, is an error that names it. Dates are serial numbers and errors such as #N/A null.
    """
    if names is None:
        names = list(dict.fromkeys(n for head in workbook_headers(files.where("length(content) > 0"), sheet) for n in head))
    names = list(names)
    clash = {FILE, LINE} & set(names)
    if clash:
        raise ValueError(f"sheets have columns named {sorted(clash)}; give the names to read without them")

    schema = StructType([StructField(FILE, StringType()), StructField(LINE, LongType()), *text_schema(names).fields])

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from _batches(path.as_py(), content.as_py(), sheet, names)

    return files.where("length(content) > 0").select("path", "content").mapInArrow(read, schema)


def _batches(path: str, content: bytes, sheet: str | None, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    columns = [FILE, LINE, *names]

    def batch(held: list[tuple[int, list[str | None]]], places: Sequence[int]) -> pa.RecordBatch:
        cells = [[row[p] if 0 <= p < len(row) else None for _, row in held] for p in places]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array([n for n, _ in held], pa.int64()),
                                           *[pa.array(c, pa.string()) for c in cells]], names=columns)

    try:
        rows = sheet_rows(content, sheet, path)
        head = next(rows, None)
        if head is None:
            return
        place = {n: i for i, n in enumerate(header_names(head[1]))}
        places = [place.get(n, -1) for n in names]
        while held := list(itertools.islice(rows, BATCH_ROWS)):
            yield batch(held, places)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"{path} is no whole workbook: {e}") from e


def read_workbooks(spark: SparkSession, path, sheet: str | None = "data", names: Sequence[str] | None = None) -> DataFrame:
    """``workbook_rows`` of the files at a path (or a list of them, or a folder); one file is the least a task reads."""
    return workbook_rows(spark.read.format("binaryFile").load(path).select("path", "content"), sheet, names)
