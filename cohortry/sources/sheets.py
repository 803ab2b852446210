"""XLSX workbooks with the standard library: a zip of XML parts, as the open document standard (ECMA-376) lays down.

A sheet holds at most 1,048,576 rows, so one workbook fits one task; many workbooks are read by many tasks.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

# The format's limit, its namespaces and content types.
MAX_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"

_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_name(index: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def column_index(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    value = 0
    for letter in reference:
        if not letter.isalpha():
            break
        value = value * 26 + ord(letter.upper()) - 64
    return value - 1


def sheet_cells(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, chosen by place or name; cells as text, rows between stored ones are empty lists."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{{{MAIN}}}sheets/{{{MAIN}}}sheet")
        chosen = listed[sheet] if isinstance(sheet, int) else next((s for s in listed if s.get("name") == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet}")
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == chosen.get(f"{{{LINKS}}}id"))
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{{{MAIN}}}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{MAIN}}}t")))
        at = 0
        with book.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                number = int(row.get("r", at + 1)) - 1
                while at < number:
                    yield []
                    at += 1
                cells: list[str | None] = []
                for cell in row.findall(f"{{{MAIN}}}c"):
                    place = column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (place + 1 - len(cells)))
                    kind, value = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
                    elif value is not None and value.text is not None:
                        cells[place] = shared[int(value.text)] if kind == "s" else value.text
                yield cells
                at += 1
                row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of one workbook or of all in a folder, as text columns under the names of its first row.

    Rows without any cell are left out. Names that are missing become column1, column2, ... by place.
    """

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                block: list[tuple[int, list[str | None]]] = []
                for place, cells in enumerate(sheet_cells(bytes(content), sheet)):
                    if any(c is not None for c in cells):
                        block.append((place, cells))
                    if len(block) == 4096:
                        yield pd.DataFrame({"path": name, "place": [p for p, _ in block], "cells": [c for _, c in block]})
                        block = []
                if block:
                    yield pd.DataFrame({"path": name, "place": [p for p, _ in block], "cells": [c for _, c in block]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "path string, place long, cells array<string>")
    head = rows.where("place = 0").orderBy("path").select("cells").first()
    if head is None:
        raise ValueError(f"{path} has no header row")
    names = [c if c else f"column{i + 1}" for i, c in enumerate(head["cells"])]
    return rows.where("place > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def sheet_bytes(names: list[str], rows: Iterator[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: numbers and booleans as such, other values as text, nulls as absent cells."""

    def cell(row: int, column: int, value: object) -> str:
        if value is None:
            return ""
        at = f"{column_name(column)}{row}"
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        text = escape(_FORBIDDEN.sub("", str(value)))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/>'
            f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{TYPES}.worksheet+xml"/></Types>',
        )
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for number, row in enumerate(itertools.chain([tuple(names)], rows), 1):
                if number > MAX_ROWS:
                    raise ValueError(f"a sheet holds at most {MAX_ROWS} rows")
                part.write(f'<row r="{number}">{"".join(cell(number, i, v) for i, v in enumerate(row))}</row>'.encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """Reports only: the rows pass the driver partition by partition, and more than a sheet holds are an error, not a cut."""
    work.put_bytes(df.sparkSession, path, sheet_bytes(df.columns, map(tuple, df.toLocalIterator()), sheet))
