"""Spreadsheet workbooks (xlsx) as a Spark data source, read from their ZIP and XML parts."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed names of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
EPOCH = datetime(1899, 12, 30)


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference.upper())[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def cell_text(cell: ElementTree.Element, shared: list[str]) -> tuple[str | None, str]:
    """A cell's value as text, and its storage kind."""
    kind = cell.get("t", "n")
    value = cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), "inline"
    if value is None:
        return None, "empty"
    if kind == "s":
        return shared[int(value)], "shared"
    if kind == "b":
        return ("true" if value == "1" else "false"), "boolean"
    if kind == "e":
        return None, "error"
    if kind == "str":
        return value, "formula"
    number = float(value)
    return (str(int(number)) if number.is_integer() else repr(number)), "number"


def cells_of(content: bytes) -> Iterator[list[tuple[str | None, str]]]:
    """Rows of the first sheet as (text, storage kind), as lists as long as their last cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        sheet = next(ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        target = targets[sheet.get(RELATION)]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        with z.open(path) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag == f"{MAIN}row":
                    out: list[tuple[str | None, str]] = []
                    for i, cell in enumerate(row.findall(f"{MAIN}c")):
                        at = column_number(cell.get("r")) if cell.get("r") else i
                        out += [(None, "empty")] * (at + 1 - len(out))
                        out[at] = cell_text(cell, shared)
                    yield out
                    row.clear()


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts."""
    return ([text for text, _ in row] for row in cells_of(content))


def table_of(content: bytes) -> tuple[list[str], Iterator[list[str | None]]]:
    """Headers without trailing unnamed columns, and the rows that are not empty."""
    rows = rows_of(content)
    headers = [(h or "").strip() for h in next(rows, [])]
    while headers and not headers[-1]:
        headers.pop()
    n = len(headers)
    fitted = ((r + [None] * n)[:n] for r in rows)
    return headers, (r for r in fitted if any(x is not None and x.strip() for x in r))


def contents(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def books(uri: str) -> list[str]:
    """The workbook itself, or all workbooks of a folder, by name."""
    fs, path = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(path)
    if info.is_file:
        return [uri]
    base = uri.rstrip("/")
    return sorted(f"{base}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".xlsx") and not f.base_name.startswith("~"))


def first_book(uri: str) -> str:
    """The workbook that sorts first in a folder."""
    found = books(uri)
    if not found:
        raise FileNotFoundError(f"no workbook in {uri}")
    return found[0]


class Workbook(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(uri)``: text columns named by the header row; a file is a task."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        headers, _ = table_of(contents(first_book(self.options["path"])))
        return ", ".join(f"`{h or f'column_{i}'}` string" for i, h in enumerate(headers))

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], [f.name for f in schema.fields])


class WorkbookReader(DataSourceReader):
    def __init__(self, uri: str, columns: list[str]):
        self.uri, self.columns = uri, columns

    def partitions(self) -> list[Workbook]:
        return [Workbook(u) for u in books(self.uri)]

    def read(self, partition: Workbook) -> Iterator[tuple]:
        headers, rows = table_of(contents(partition.uri))
        at = {h or f"column_{i}": i for i, h in enumerate(headers)}
        places = [at.get(c) for c in self.columns]
        for row in rows:
            yield tuple(None if p is None else row[p] for p in places)


def read_workbook(spark: SparkSession, uri: str, required: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    df = spark.read.format("workbook").load(uri if "://" in uri else f"file://{uri}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def cell_kinds(spark: SparkSession, uri: str) -> DataFrame:
    """``name, kind, n``: how the cells below each header are stored, over all workbooks of a folder; rows without a value do not count."""
    found = books(uri)
    paths = spark.createDataFrame([(u,) for u in found], "uri string").repartition(max(1, len(found)))
    schema = pa.schema([("name", pa.string()), ("kind", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for book in (u for b in batches for u in b.column("uri").to_pylist()):
            rows = cells_of(contents(book))
            headers = [(text or "").strip() for text, _ in next(rows, [])]
            for row in rows:
                if any(text is not None and text.strip() for text, _ in row):
                    kinds = [kind for _, kind in row] + ["empty"] * (len(headers) - len(row))
                    counts.update((h, k) for h, k in zip(headers, kinds, strict=False) if h)
        if counts:
            yield pa.RecordBatch.from_pylist([{"name": h, "kind": k, "n": n} for (h, k), n in counts.items()], schema=schema)

    return paths.mapInArrow(run, "name string, kind string, n long").groupBy("name", "kind").agg(F.sum("n").alias("n"))


def cell_of(value: object) -> str:
    """A cell as XML: numbers and booleans by their kind, all else as inline text."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def book_of(headers: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet with a header row."""
    out = io.BytesIO()
    main, office, package = MAIN[1:-1], RELATION[1 : RELATION.index("}")], "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for row in (headers, *rows):
                f.write(f"<row>{''.join(map(cell_of, row))}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(df: DataFrame, uri: str, name: str = "book", rows: int = 100_000) -> list[str]:
    """Write ``df`` as workbooks of at most so many rows, named by partition; the names written.

    A workbook appears under its name only when whole, and a second attempt of a task replaces it.
    """
    columns = df.columns
    schema = pa.schema([("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)

        def put(part: list[tuple], number: int) -> pa.RecordBatch:
            file = f"{name}-{task:05d}-{number:05d}.xlsx"
            part_name = f"{folder}/~{file}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part_name) as f:
                f.write(book_of(columns, part))
            fs.move(part_name, f"{folder}/{file}")
            return pa.RecordBatch.from_pylist([{"file": file}], schema=schema)

        held, number = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == rows:
                    yield put(held, number)
                    held, number = [], number + 1
        if held:
            yield put(held, number)

    return sorted(r["file"] for r in df.mapInArrow(run, "file string").collect())


def excel_time(days: float) -> datetime:
    return EPOCH + timedelta(seconds=round(days * 86400))
