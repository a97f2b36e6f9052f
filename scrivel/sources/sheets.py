"""Spreadsheet dictionaries (SRC5, SRC6): the first sheet of an .xlsx file, by its zipped XML. Dictionaries are small: one file is read whole."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
FIELDS = "ordinal int, field_id string, field_type string, label string, picklist_id string, required boolean, remarks string, sample_value string"
PICKLISTS = "picklist_id string, ordinal int, external_code string, label_vi string, label_en string, option_id string, status string"


def _place(reference: str) -> int:
    """The number of a cell's column, A as 0."""
    out = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        out = 26 * out + ord(letter) - 64
    return out - 1


def rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells as text) of the first sheet; numbers without a fraction lose their point, empty cells are null."""
    file = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in file.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(file.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    first = min((n for n in file.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
    for k, row in enumerate(ElementTree.fromstring(file.read(first)).iter(f"{_S}row")):
        cells: list[str | None] = []
        for n, cell in enumerate(row.findall(f"{_S}c")):
            at = _place(cell.get("r")) if cell.get("r") else n
            cells += [None] * (at + 1 - len(cells))
            kind, value = cell.get("t"), cell.findtext(f"{_S}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif value is not None and kind in (None, "n"):
                value = re.sub(r"\.0+$", "", value)
            cells[at] = value or None
        yield int(row.get("r", k + 1)), cells


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def field_definitions(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: rows from the second on, columns A to G; rows without an id are left out, types default to String."""
    out = []
    for number, cells in rows(_content(spark, path)):
        a = [*cells, *[None] * 7][:7]
        if number >= 2 and a[0]:
            out.append((len(out), a[0], a[1] or "String", a[2] or "", a[3], (a[4] or "").upper() == "Y", a[5] or "", a[6] or ""))
    return spark.createDataFrame(out, FIELDS)


def picklists(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: rows from the third on, columns B, D, F, G, H and I; rows without a picklist are left out, the status defaults to A, zero is no option id."""
    out = []
    for number, cells in rows(_content(spark, path)):
        a = [*cells, *[None] * 9][:9]
        if number >= 3 and a[1]:
            option = str(int(float(a[8]))) if a[8] and float(a[8]) else ""
            out.append((a[1], len(out), a[3] or "", a[5] or "", a[6] or "", option, a[7] or "A"))
    return spark.createDataFrame(out, PICKLISTS)
