"""Workbooks in the Office Open XML format, read by tasks from the zip and its sheets' XML.

A task takes a sheet and streams its rows; strings come from the shared table, dates from
numbers whose style shows one. Cells become text in the first place, as in a delimited file,
and columns get their types from all of their values.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show a date or a time (fixed values of the format).
DATE_FORMATS = (*range(14, 23), *range(45, 48))
ROW = "path string, sheet string, number int, cells array<string>"


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), part(targets[s.get(RELATION)])) for s in found]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format has days, months, years or hours in it."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()
    dated = {i for i, code in own.items() if re.search(r"[ymdh]", plain(code))} | set(DATE_FORMATS)
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in dated}


def starts_in_1904(book: zipfile.ZipFile) -> bool:
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
    return found is not None and found.get("date1904") in ("1", "true")


def dated(serial: float, start: datetime) -> str:
    moment = start + timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def place(reference: str) -> int:
    """The column of a cell's reference, from 0."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def rows_of(book: zipfile.ZipFile, part: str):
    """(number, cells) of the sheet's rows that have a value."""
    strings, styles, start = shared_strings(book), date_styles(book), datetime(1904, 1, 1) if starts_in_1904(book) else datetime(1899, 12, 30)

    def text_of(cell) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return strings[int(value.text)]
        if kind == "b":
            return "true" if value.text == "1" else "false"
        if kind == "e":
            return None
        if kind == "n" and int(cell.get("s", 0)) in styles:
            return dated(float(value.text), start)
        return value.text

    number = 0
    with book.open(part) as sheet:
        for _, row in ElementTree.iterparse(sheet):
            if row.tag != f"{MAIN}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = place(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text_of(cell)
            if any(c is not None for c in cells):
                yield number, cells
            row.clear()


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def book_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, number, cells) of a workbook's sheet, the first by default, or of those of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def names(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    found = [(n, p) for n, p in sheets_of(book) if sheet is None or n == sheet][: 1 if sheet is None else None]
                if found:
                    yield table(path=[path] * len(found), sheet=[n for n, _ in found], part=[p for _, p in found], content=[content] * len(found))

    def rows(batches):
        for batch in batches:
            for path, name, part, content in zip(*(batch.column(c).to_pylist() for c in ("path", "sheet", "part", "content"))):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    lines = rows_of(book, part)
                    while held := list(islice(lines, 10_000)):
                        yield table(path=[path] * len(held), sheet=[name] * len(held), number=pa.array([n for n, _ in held], pa.int32()), cells=pa.array([c for _, c in held], pa.list_(pa.string())))

    found = files.mapInArrow(names, "path string, sheet string, part string, content binary")
    return found.repartition("path", "sheet").mapInArrow(rows, ROW)  # a sheet is a task's work


def named_columns(rows: DataFrame) -> DataFrame:
    """A sheet's first row as names, the others as text columns; a column without a name is called by its place."""
    first = rows.orderBy("path", "number").first()
    if first is None:
        return rows.select().limit(0)
    names, taken = [], set()
    for i, c in enumerate(first["cells"]):
        name = (c or "").strip() or f"Unnamed: {i}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    heads = rows.groupBy("path").agg(F.min("number").alias("head"))
    body = rows.join(F.broadcast(heads), "path").filter(F.col("number") > F.col("head"))  # a row a file
    return body.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
