"""A reader of the first sheet of an .xlsx workbook, on the standard library alone. All cells are
text; a whole number stored as 12345.0 reads 12345. Catalogues are small, so one task reads one file;
the file's bytes come from Spark's binary source, which opens any path that Spark can."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet, header included, filled up to one width."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(x.text or "" for x in item.iter(SPACE + "t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{SPACE}sheets")[0].get(LINK)
        target = next(x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if x.get("Id") == first)
        sheet = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in sheet.iter(SPACE + "row"):
        values: list[str | None] = []
        for cell in row.iter(SPACE + "c"):
            column = 0
            for letter in re.match("[A-Z]*", cell.get("r", "")).group():
                column = column * 26 + ord(letter) - 64
            values += [None] * ((column or len(values) + 1) - 1 - len(values))
            values.append(cell_text(cell, shared))
        rows.append(values)
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def cell_text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(SPACE + "v")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter(SPACE + "t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", value.text):
        return value.text.split(".")[0]
    return value.text


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The sheet as text columns named by its first row, with __row for the rows' order."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.mapInArrow(_rows, "row long, cells array<string>")
    header = first.where("row = 0").select("cells").first()
    if header is None:
        raise ValueError(f"{path} has no rows")
    cells = first.where("row > 0")
    return cells.select(*(cells["cells"][i].alias(str(name)) for i, name in enumerate(header["cells"]) if name), cells["row"].alias("__row"))


def _rows(batches):
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows = sheet_rows(data)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["row", "cells"])
