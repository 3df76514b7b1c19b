"""NPY and NPZ arrays as a data source: the driver reads headers and plans row ranges by byte offset."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from halyard.session import shared_path

#: Bytes of rows that one partition reads, and rows of one Arrow batch.
PART_BYTES, BATCH_ROWS = 64 << 20, 8192


class Layout(NamedTuple):
    """Where the rows of an array lie in a file: ``offset`` of the first row, or ``member`` of an archive if it is compressed."""

    path: str
    member: str | None
    offset: int
    dtype: str
    rows: int
    width: int


def header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and length of the header of an array file."""
    version = npy.read_magic(stream)
    shape, fortran, dtype = npy.read_array_header_1_0(stream) if version == (1, 0) else npy.read_array_header_2_0(stream)
    if dtype.hasobject or dtype.kind not in "iufbSU":
        raise ValueError(f"arrays of {dtype} are not read")
    if len(shape) not in (1, 2) or (fortran and len(shape) == 2 and min(shape) > 1):
        raise ValueError("only arrays of one or two dimensions in row order are read")
    return shape, dtype, stream.tell()


def laid_out(fs: pafs.FileSystem, path: str, name: str | None) -> Layout:
    """The layout of an array file, or of the array ``name`` in an archive of arrays."""
    with fs.open_input_file(path) as f:
        if not path.endswith(".npz"):
            shape, dtype, offset = header(f)
            return Layout(path, None, offset, dtype.str, shape[0], shape[1] if len(shape) == 2 else 1)
        with zipfile.ZipFile(f) as z:
            info = z.getinfo(f"{name}.npy")
            with z.open(info) as member:
                shape, dtype, offset = header(member)
        plain = info.compress_type == zipfile.ZIP_STORED
        if plain:
            f.seek(info.header_offset + 26)
            sizes = np.frombuffer(f.read(4), dtype="<u2")
            offset += info.header_offset + 30 + int(sizes.sum())
    return Layout(path, None if plain else info.filename, offset, dtype.str, shape[0], shape[1] if len(shape) == 2 else 1)


class Rows(InputPartition):
    def __init__(self, layout: Layout, start: int, stop: int):
        self.layout, self.start, self.stop = layout, start, stop


class ArraySource(DataSource):
    """Options: ``path`` (a file or folder), ``array`` (its name in archives), ``rows`` of a partition.

    Columns: ``file``, ``row`` (from 0, within the file) and ``values`` (doubles) or, for text, ``text``.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def layouts(self) -> list[Layout]:
        fs, path = pafs.FileSystem.from_uri(self.options["path"])
        info = fs.get_file_info(path)
        found = [path] if info.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.endswith((".npy", ".npz")) and not f.base_name.startswith((".", "_", "~")))
        return [laid_out(fs, p, self.options.get("array")) for p in found]

    def schema(self) -> str:
        kinds = {np.dtype(x.dtype).kind in "SU" for x in self.layouts()}
        if len(kinds) > 1:
            raise ValueError("arrays of text and of numbers in one folder")
        return "file string, row long, text string" if kinds == {True} else "file string, row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"], self.layouts(), int(self.options.get("rows", 0)))


class ArrayReader(DataSourceReader):
    def __init__(self, uri: str, layouts: list[Layout], rows: int):
        self.uri, self.layouts, self.rows = uri, layouts, rows

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for x in self.layouts:
            size = np.dtype(x.dtype).itemsize * x.width
            step = x.rows if x.member else self.rows or max(1, PART_BYTES // max(size, 1))
            out += [Rows(x, i, min(i + step, x.rows)) for i in range(0, x.rows, max(step, 1))]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Rows):
            return
        x, dtype = partition.layout, np.dtype(partition.layout.dtype)
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(x.path) as f:
            stream = zipfile.ZipFile(f).open(x.member) if x.member else f
            if x.member:
                stream.read(x.offset)
            else:
                stream.seek(x.offset + partition.start * dtype.itemsize * x.width)
            for start in range(partition.start, partition.stop, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.stop - start)
                data = stream.read(n * dtype.itemsize * x.width)
                if len(data) < n * dtype.itemsize * x.width:
                    raise ValueError(f"{x.path} ends before row {start + n}")
                values = np.frombuffer(data, dtype=dtype)
                rows = [pa.array([x.path.rpartition("/")[2]] * n), pa.array(np.arange(start, start + n))]
                if dtype.kind in "SU":
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(values.astype(str).tolist())], ["file", "row", "text"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.width), pa.array(values.astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([*rows, lists], ["file", "row", "values"])


def read_arrays(spark: SparkSession, uri: str, array: str | None = None, rows: int | None = None) -> DataFrame:
    """``file, row, values`` (or ``text``) of the arrays at ``uri``, in partitions of ``rows`` rows."""
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("arrays").option("path", uri)
    for name, value in (("array", array), ("rows", rows)):
        reader = reader.option(name, str(value)) if value is not None else reader
    return reader.load()


def aligned(ids: DataFrame, values: DataFrame) -> DataFrame:
    """``id, values``: arrays of ids and of values brought together by file and row; a row that one of them lacks raises an error."""
    both = ids.select("file", "row", F.col("values")[0].cast("long").alias("id"), F.lit(True).alias("a")).join(values.select("file", "row", "values", F.lit(True).alias("b")), ["file", "row"], "full")
    whole = F.when(F.col("a") & F.col("b"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("ids and values differ in row "), F.col("row").cast("string"), F.lit(" of "), F.col("file"))).cast("long"))
    return both.select(whole.alias("id"), "values")


def write_arrays(df: DataFrame, id_col: str, vector_col: str, dtype: str = "<f4", rows: int = 100_000) -> tuple[str, list[str]]:
    """Write ids and vectors as archives with the arrays ``ids`` and ``values``; the folder, and the files of the attempts that count."""
    uri = shared_path(df.sparkSession, "arrays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)

        def put(ids: list[int], vectors: list[list[float]]) -> pa.RecordBatch:
            file = f"part-{uuid.uuid4().hex}.npz"
            with fs.open_output_stream(f"{folder}/~{file}") as f:
                np.savez(f, ids=np.array(ids, dtype="<i8"), values=np.array(vectors, dtype=dtype))
            fs.move(f"{folder}/~{file}", f"{folder}/{file}")
            return pa.RecordBatch.from_pydict({"file": [file]})

        ids, vectors = [], []
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield put(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield put(ids, vectors)

    names = [r.file for r in df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "file string").collect()]
    return uri, sorted(names)
