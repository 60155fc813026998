"""Workbook files (xlsx) as tables of cells (SRC4, SRC15-SRC17, SRC28): (path, sheet, row, col, value), rows and columns from 0.

A workbook is a zip of XML parts. Files come through Spark's binary scan, so they may lie in any store; a task holds one file at a time, packed,
and streams its sheets. What the cells mean is DataFrame work: header rows, codes, rules.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = "path string, sheet string, row int, col int, value string"
_M, _R = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REF = re.compile(r"([A-Z]+)([0-9]+)")
#: Cells that a task holds before it hands them on.
MOST_CELLS = 20_000


def _place(ref: str) -> tuple[int, int]:
    letters, number = _REF.fullmatch(ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(number) - 1, col - 1


def read_file(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the cells that have a value. Numbers come as written; booleans as true and false."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{_M}t"))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                for _, x in ElementTree.iterparse(stream):
                    if x.tag == f"{_M}si":
                        shared.append(text(x))
                        x.clear()
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            name = targets[sheet.get(f"{_R}id")]
            part = name.lstrip("/") if name.startswith("/") else posixpath.normpath(posixpath.join("xl", name))
            with book.open(part) as stream:
                row, data = -1, None
                for event, x in ElementTree.iterparse(stream, ("start", "end")):
                    if x.tag == f"{_M}sheetData" and event == "start":
                        data = x
                    if x.tag == f"{_M}row" and event == "start":
                        row, col = int(x.get("r")) - 1 if x.get("r") else row + 1, -1
                    elif x.tag == f"{_M}c" and event == "end":
                        row, col = _place(x.get("r")) if x.get("r") else (row, col + 1)
                        kind, v = x.get("t"), x.find(f"{_M}v")
                        if kind == "inlineStr":
                            value = text(x)
                        elif v is None or v.text is None:
                            continue
                        else:
                            value = shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else v.text
                        if value != "":
                            yield sheet.get("name"), row, col, value
                    elif x.tag == f"{_M}row" and event == "end":
                        x.clear()
                        if data is not None:
                            data.remove(x)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            found = read_file(content.as_py())
            while rows := list(itertools.islice(found, MOST_CELLS)):
                columns = zip(*rows, strict=True)
                sheet, row, col, value = (pa.array(c, kind) for c, kind in zip(columns, kinds[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.repeat(path, len(rows)), sheet, row, col, value], names=["path", "sheet", "row", "col", "value"])


class _Book:
    """An xlsx file of inline texts and numbers, written a row at a time: sheets one after the other, each row above the next."""

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def __init__(self):
        self.out, self.names, self.part = io.BytesIO(), [], None
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)

    def sheet(self, name: str) -> None:
        self._close()
        self.names.append(name)
        self.part = self.zip.open(f"xl/worksheets/s{len(self.names)}.xml", "w", force_zip64=True)
        self.part.write(f'<worksheet xmlns="{self.main}"><sheetData>'.encode())

    def row(self, number: int, values: list) -> None:
        """number: from 0."""
        cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{escape(v or "")}</t></is></c>'
        self.part.write((f'<row r="{number + 1}">' + "".join(map(cell, values)) + "</row>").encode())

    def _close(self) -> None:
        if self.part:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def content(self) -> bytes:
        self._close()
        named = list(enumerate(self.names, 1))
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{self.main}" xmlns:r="{self.rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in named) + "</sheets></workbook>")
        self.zip.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{self.rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i, _ in named) + "</Relationships>")
        self.zip.close()
        return self.out.getvalue()


def file_of(sheets: dict[str, list[list]]) -> bytes:
    """An xlsx file of inline texts and numbers."""
    book = _Book()
    for name, rows in sheets.items():
        book.sheet(name)
        for n, r in enumerate(rows):
            if r:
                book.row(n, r)
    return book.content()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workbooks of cells that come sorted by path, sheet, row and column: a row is held, and the file as far as it is written, packed."""
    book, at, values = None, (None, None, None), []
    whole = lambda path, book: pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([book.content()], pa.binary())], names=["path", "content"])
    for batch in batches:
        for path, sheet, row, col, value in zip(*[batch.column(c).to_pylist() for c in ("path", "sheet", "row", "col", "value")], strict=True):
            if (path, sheet, row) != at:
                if values:
                    book.row(at[2], values)
                if book is None or path != at[0]:
                    if book is not None:
                        yield whole(at[0], book)
                    book, at = _Book(), (path, None, None)
                if sheet != at[1]:
                    book.sheet(sheet)
                at, values = (path, sheet, row), []
            values += [""] * (col - len(values)) + [value]
    if book is not None:
        if values:
            book.row(at[2], values)
        yield whole(at[0], book)


def files_of(table: DataFrame) -> DataFrame:
    """(path, content): a workbook for each path of (path, sheet, row, col, value), written by tasks. A workbook is one zip file: a task gets its cells in order and writes them as they come."""
    cells = table.select("path", "sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")
    return cells.repartition("path").sortWithinPartitions("path", "sheet", "row", "col").mapInArrow(_written, "path string, content binary")


def cells(files: DataFrame) -> DataFrame:
    """The cells of workbooks (path, content)."""
    return files.select("path", "content").mapInArrow(_read, CELLS)


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """The cells of all workbooks at or below path."""
    return cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def headed(table: DataFrame, marks: list[str]) -> DataFrame:
    """(path, sheet, row, record map name -> value) of sheets with a header: the first row that has all of marks; names are trimmed and lower-cased."""
    low = F.lower(F.trim("value"))
    head = table.where(low.isin(*[m.lower() for m in marks])).groupBy("path", "sheet", "row").agg(F.count_distinct(low).alias("n")).where(F.col("n") == len({m.lower() for m in marks}))
    head = head.groupBy("path", "sheet").agg(F.min("row").alias("h"))
    t = table.join(head, ["path", "sheet"])
    # of columns that share a name the first has it
    names = t.where("row = h").groupBy("path", "sheet", low.alias("name")).agg(F.min("col").alias("col"))
    rows = t.where("row > h").join(names, ["path", "sheet", "col"]).groupBy("path", "sheet", "row")
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("name", F.trim("value").alias("v")))).alias("record"))


def records(table: DataFrame, columns: dict[str, str], marks: list[str] | None = None) -> DataFrame:
    """(path, sheet, row, and a text column for each of columns: own name -> name in the header; null where a row has none)."""
    h = headed(table, marks or list(columns.values())[:1])
    return h.select("path", "sheet", "row", *[F.try_element_at("record", F.lit(name.lower())).alias(own) for own, name in columns.items()])


def kinds(table: DataFrame) -> DataFrame:
    """SRC28: (path, kind) by a workbook's sheets: dpm_dictionary, annotated_templates or unknown."""
    names = F.collect_set(F.lower(F.trim("sheet")))
    g = table.groupBy("path").agg(names.alias("names"))
    template = F.exists("names", lambda s: s.rlike(r"^[a-z].*[0-9]") & s.contains("."))
    whole = F.size(F.array_intersect("names", F.array(*[F.lit(x) for x in ("metrics", "dimensions", "domains")]))) == 3
    return g.select("path", F.when(whole, "dpm_dictionary").when(template, "annotated_templates").otherwise("unknown").alias("kind"))
