"""Workbooks as rows of cells, read with the standard library alone.

Files come through Spark's own reader, so they may lie wherever Spark reads, one row a workbook; each is unpacked in the task that holds it,
row by row. Cells give the values that were stored with formulas, as text: whole numbers and fractions as they are written, dates and times by the cell's
format, shared and inline strings, truth values, errors.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number formats that stand for dates or times without being written out in the file, rows of a batch, and the days that serial numbers count from.
DATE_FORMATS, BATCH = {*range(14, 23), 45, 46, 47}, 2_000
EPOCH, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
_FORM = "path string, sheet_order int, sheet string, physical long, cells array<string>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of that name in a part of the book, each given out whole and then forgotten."""
    above: list[ElementTree.Element] = []
    with book.open(name) as part:
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if _local(e.tag) == wanted:
                yield e
                e.clear()
                if above:
                    above[-1].remove(e)


def _said(e: ElementTree.Element) -> str:
    """The text of a string item, without readings."""
    out = []
    for child in e:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Places of the cell formats that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for e in root.iter():
        if _local(e.tag) == "numFmt":
            bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h|m|s)[^\]]*\]', "", e.get("formatCode", ""), flags=re.IGNORECASE)
            own[int(e.get("numFmtId", 0))] = bool(re.search("[dmhysDMHYS]", bare.split(";")[0]))
    formats = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    return {k for k, x in enumerate(formats) if own.get(int(x.get("numFmtId", 0)), int(x.get("numFmtId", 0)) in DATE_FORMATS)}


def _moment(value: float, epoch: datetime.datetime) -> str:
    days, part = divmod(value, 1)
    rest = datetime.timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= value < 1 and epoch == EPOCH and not rest.days:
        return str((datetime.datetime.min + rest).time())
    if 0 < value < 60 and epoch == EPOCH:  # the calendar of serial numbers has a day in 1900 that never was
        days += 1
    return str(epoch + datetime.timedelta(days=days) + rest)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows_of(data: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """Order and title of the sheet, number of the row, and cells of every row that is in the workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        links = {e.get("Id"): (e.get("Type", ""), e.get("Target", "")) for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
        shared = [_said(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        epoch = EPOCH_1904 if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter()) else EPOCH
        dated = _date_styles(book)
        order = 0
        for sheet in (e for e in root.iter() if _local(e.tag) == "sheet"):
            kind, target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            if not kind.endswith("/worksheet"):
                continue
            name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            number = 0
            for row in _elements(book, name, "row"):
                number = int(row.get("r", number + 1))
                cells: list[str] = []
                for c in (c for c in row if _local(c.tag) == "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _value(c, shared, dated, epoch)
                yield order, sheet.get("name") or "Sheet", number, cells
            order += 1


def _value(c: ElementTree.Element, shared: list[str], dated: set[int], epoch: datetime.datetime) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(_said(x) for x in c if _local(x.tag) == "is")
    text = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
    if not text or kind in ("str", "e", "d"):
        return text
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return str(text not in ("0", "false"))
    value = float(text) if re.search("[.eE]", text) else int(text)
    return _moment(value, epoch) if int(c.get("s", 0)) in dated else str(value)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_order, sheet, physical, cells of all rows of the worksheets in the workbooks below path; white space in a cell as one space.

    What is no workbook stops the query. For operators.tables.build_sheet() give path and sheet one name, where there are several files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                held: list[tuple] = []
                for order, sheet, number, cells in rows_of(data.as_py()):
                    held.append((name.as_py(), order, sheet, number, [" ".join(c.split()) for c in cells]))
                    if len(held) == BATCH:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    return found.select("path", "content").mapInArrow(run, _FORM)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "sheet_order", "sheet", "physical", "cells"])


def sheets(rows: DataFrame) -> DataFrame:
    """Rows of read_xlsx() under one key each for build_sheet(): sheet (path and title), physical, cells."""
    return rows.select(F.concat_ws("#", "path", "sheet").alias("sheet"), "physical", "cells")
