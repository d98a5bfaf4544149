"""Rows of the first sheet of Excel workbooks, whose files are zipped XML; no spreadsheet library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_BATCH = 10_000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    """All runs of text of a string, but not its reading aid."""
    return "".join(t.text or "" for part in node if _local(part.tag) != "rPh" for t in part.iter() if _local(t.tag) == "t")


def _column(reference: str) -> int:
    """A -> 0, Z -> 25, AA -> 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def first_sheet(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the workbook's first sheet, cell by cell; empty cells are null, and so are errors."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            strings = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        wanted = next(v for k, v in sheets[0].attrib.items() if _local(k) == "id" and k != "id")
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.attrib["Target"] for r in links if r.attrib["Id"] == wanted)
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with book.open(path) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if _local(node.tag) != "row":
                    continue
                row: list[str | None] = []
                for cell in node:
                    at = _column(cell.attrib["r"]) if "r" in cell.attrib else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind = cell.attrib.get("t", "n")
                    if kind == "inlineStr":
                        row[at] = "".join(_text(part) for part in cell)
                        continue
                    value = next((v.text for v in cell if _local(v.tag) == "v"), None)
                    if value is not None and kind != "e":
                        row[at] = strings[int(value)] if kind == "s" else value
                yield row
                node.clear()


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the first row. ``path``: a workbook, or a folder or pattern of workbooks
    of one layout; a file is read by one task. The names are those of one of the workbooks, columns of the others
    go by name. A workbook without rows gives none."""
    files = spark.read.format("binaryFile").load(path).select("content")
    one = T.StructType([T.StructField("names", T.ArrayType(T.StringType()))])

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([next(first_sheet(content), [])], pa.list_(pa.string()))], names=one.names)

    found = files.limit(1).mapInArrow(header, one).first()
    names = [n for n in (found["names"] if found else []) if n]
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField("rev_time", T.StringType())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                sheet = first_sheet(content)
                place = {n: k for k, n in enumerate(next(sheet, [])) if n}
                held: list[list[str | None]] = []

                def emit() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[place[n]] if n in place and place[n] < len(r) else None for r in held], pa.string()) for n in names], names=names)

                for row in sheet:
                    held.append(row)
                    if len(held) == ROWS_A_BATCH:
                        yield emit()
                        held = []
                if held:
                    yield emit()

    table = files.mapInArrow(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return table.select(*[F.col(f"`{n}`") for n in names])
