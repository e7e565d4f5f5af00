"""Workbooks to read back: one sheet of texts and numbers among others, as bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape, quoteattr

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def column_letters(i: int) -> str:
    letters = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def workbook(rows: Iterable[Sequence[object]], sheet: str = "data", raw: dict[tuple[int, int], str] | None = None) -> bytes:
    """Texts become shared strings, numbers plain cells, None no cell. ``raw`` gives cells (row, column from 0) as XML."""
    strings: dict[str, int] = {}
    lines = []
    letters: list[str] = []
    for n, row in enumerate(rows):
        cells = []
        letters += [column_letters(i) for i in range(len(letters), len(row))]
        for i, value in enumerate(row):
            at = f"{letters[i]}{n + 1}"
            if raw and (n, i) in raw:
                cells.append(raw[n, i].replace("<c", f'<c r="{at}"', 1))
            elif isinstance(value, str):
                cells.append(f'<c r="{at}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>')
            elif value is not None:
                cells.append(f'<c r="{at}"><v>{value}</v></c>')
        lines.append(f'<row r="{n + 1}">{"".join(cells)}</row>')
    shared = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=3) as book:
        book.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_LINKS}"><sheets>'
                      f'<sheet name="notes" sheetId="1" r:id="rId1"/><sheet name={quoteattr(sheet)} sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">'
                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{shared}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {_MAIN}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()
