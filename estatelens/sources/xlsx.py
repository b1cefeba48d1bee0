"""XLSX listings, read with zip and XML from the standard library.

Workbooks come through Spark's own file layer as binary rows, so any file system that Spark reads will do. One task reads
one workbook and streams the rows of one sheet once: ``sheet`` by name, or by ``strategy`` ("largest": most rows, the first of
equals; anything else: the first sheet). Where any cell of the path column is a formula without text, every row of that workbook whose path cell
holds a HYPERLINK formula takes its first argument. All columns are strings; missing cells are null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse, parse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINK = re.compile(r'HYPERLINK\(\s*"([^"]+)"', re.I)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in order; parts by relationship."""
    targets = {r.get("Id"): r.get("Target") for r in parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    out = []
    for node in parse(book.open("xl/workbook.xml")).getroot().iter():
        if _local(node.tag) == "sheet":
            key = next((v for k, v in node.attrib.items() if _local(k) == "id"), None)
            target = targets.get(key) or ""
            out.append((node.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _rows_in(book: zipfile.ZipFile, part: str) -> int:
    most = 0
    with book.open(part) as f:
        for _, node in iterparse(f):
            if _local(node.tag) == "row":
                most = max(most, int(node.get("r") or most + 1))
            node.clear()
    return most


def choose_sheet(book: zipfile.ZipFile, sheet: str | None, strategy: str) -> str:
    """Part of the wanted sheet; ValueError if a named one does not exist."""
    known = sheets(book)
    if sheet:
        part = dict(known).get(sheet)
        if part is None:
            raise ValueError(f"no sheet {sheet!r}")
        return part
    if strategy == "largest":
        return max(known, key=lambda s: _rows_in(book, s[1]))[1]  # max keeps the first of equals
    return known[0][1]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in iterparse(f):
            if _local(node.tag) == "si":
                out.append("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))
                node.clear()
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_rows(content: bytes, sheet: str | None, strategy: str) -> Iterator[tuple[int, dict[int, tuple[str | None, str | None]]]]:
    """(row number from 1, column -> (text, formula)) of a sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, part = _strings(book), choose_sheet(book, sheet, strategy)
        number = 0
        with book.open(part) as f:
            for _, node in iterparse(f):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r") or number + 1)
                cells, at = {}, -1
                for c in node:
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kids = {_local(k.tag): k for k in c}
                    text = kids["v"].text if "v" in kids else "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t") or None
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    cells[at] = (text, kids["f"].text if "f" in kids else None)
                yield number, cells
                node.clear()


def header_of(content: bytes, sheet: str | None, strategy: str, header_row: int) -> dict[int, str]:
    """Column -> title of the header, which follows ``header_row`` other rows; empty if there is none."""
    for number, cells in read_rows(content, sheet, strategy):
        if number > header_row:
            return {i: text for i, (text, _) in sorted(cells.items()) if text} if number == header_row + 1 else {}
    return {}


BATCH = 10_000


def read_workbooks(spark: SparkSession, path: str, header_row: int = 0, strategy: str = "largest", sheet: str | None = None, path_column: str = "Path") -> DataFrame:
    """Rows of all workbooks of a path, pattern or folder; the columns are those of all headers, in order of their place."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n) for content in batch.column("content").to_pylist() for i, n in header_of(content, sheet, strategy, header_row).items()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([n for _, n in found], pa.string())], names=["at", "name"])

    titles = books.mapInArrow(headers, "at int, name string").groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in titles.orderBy("at", "name").collect()]  # as many as the headers have columns
    if not names:
        raise ValueError(f"no header in row {header_row}")
    columns = [f"c{i}" for i in range(len(names))]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at = {title: i for i, title in header_of(content, sheet, strategy, header_row).items()}
                rows: list[list[str | None]] = []
                for number, cells in read_rows(content, sheet, strategy):
                    if number <= header_row + 1:
                        continue
                    row = [cells.get(at[n], (None, None))[0] if n in at else None for n in names]
                    text, formula = cells.get(at[path_column], (None, None)) if path_column in at else (None, None)
                    link = _LINK.search(formula) if formula else None
                    if any(v is not None for v in row) or link:
                        rows.append([file, link[1] if link else None, "1" if formula and not text else None, *row])
                    if len(rows) == BATCH:
                        yield _texts(rows, columns)
                        rows = []
                yield _texts(rows, columns)

    read = books.mapInArrow(body, ", ".join(f"{c} string" for c in ("file", "link", "hidden", *columns)))
    if path_column in names:
        mended = read.groupBy(F.col("file").alias("__file")).agg(F.max("hidden").alias("__mend"))
        key = columns[names.index(path_column)]
        read = read.join(mended, F.col("file") == F.col("__file")).withColumn(key, F.when(F.col("__mend").isNotNull(), F.coalesce("link", key)).otherwise(F.col(key)))
    shown = read.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    return shown.filter(F.greatest(*[F.col(f"`{n.replace('`', '``')}`") for n in names], F.lit(None)).isNotNull())


def _texts(rows: list[list[str | None]], columns: list[str]) -> pa.RecordBatch:
    cells = list(zip(*rows)) if rows else [[] for _ in range(len(columns) + 3)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cells], names=["file", "link", "hidden", *columns])
