"""Tables as the sheets of an Excel workbook, made with the standard library alone."""

from __future__ import annotations

import math
import os
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Limits and names of the file format.
ROWS, CHARACTERS = 1_048_576, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Characters that XML cannot hold; the format writes them by their number.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def _cell(v) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f"<c><v>{v!r}</v></c>"
    text = str(v)
    if len(text) > CHARACTERS:
        raise ValueError(f"a cell holds at most {CHARACTERS} characters, not {len(text)}")
    text = escape(_BARRED.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _row(values) -> bytes:
    return f"<row>{''.join(map(_cell, values))}</row>".encode()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Write each table as a sheet, column names first, in the order of its rows; the file is the driver's.

    One partition at a time reaches the driver. A table of more rows than a sheet can hold raises and leaves no file, as does a
    text longer than a cell can hold. Nulls, NaN and infinities are empty cells."""
    part = f"{path}.part"
    numbers = range(1, len(sheets) + 1)
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{_KIND}.worksheet+xml"/>' for n in numbers)
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{types}</Types>')
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            named = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="r{n}"/>' for n, name in zip(numbers, sheets, strict=True))
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{named}</sheets></workbook>')
            links = "".join(f'<Relationship Id="r{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
            for n, (name, df) in zip(numbers, sheets.items(), strict=True):
                with z.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as f:
                    f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + _row(df.columns))
                    for k, row in enumerate(df.toLocalIterator(), 2):
                        if k > ROWS:
                            raise ValueError(f"sheet {name} has more than {ROWS} rows")
                        f.write(_row(row))
                    f.write(b"</sheetData></worksheet>")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
