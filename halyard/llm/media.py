"""Media columns: payloads as PNG images in tar archives, and a data source that reads them by byte range.

The writer stores each payload as 8-bit grey samples, 64 to a row, in a PNG file, members of tar
archives; beside each archive lies a list of sync points, offsets of members about ``SYNC_BYTES`` apart.
The data source lists the archives of a folder, plans ranges between sync points, and streams members in
Arrow batches of bounded size. Each member is read by its offset; a failed read is tried again on a
fresh handle, that member alone, and after the last try the member becomes a row with its error.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from halyard.llm.common import bounded, rows_of
from halyard.llm.store import Ranges, committed, files, make_dir, place
from halyard.session import cut, shared_path

WIDTH = 64
FILE_BYTES = 128 << 20
SYNC_BYTES = 8 << 20
BATCH_BYTES = 16 << 20
TRIES = 3
BLOCK = tarfile.BLOCKSIZE
PNG = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes) -> bytes:
    """With zero bytes up to a positive multiple of the row width."""
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def png(payload: bytes) -> bytes:
    """The padded payload as an 8-bit grey image; the length without padding goes into a text chunk."""
    samples = np.frombuffer(padded(payload), dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = samples
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"bytes\0%d" % len(payload)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Samples of 8-bit grey rows, each behind its filter type."""
    kinds, data = rows[:, 0], rows[:, 1:]
    if not kinds.any():
        return data
    out = np.zeros(data.shape, dtype=np.uint8)
    above = np.zeros(data.shape[1], dtype=np.int64)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), data.astype(np.int64), strict=True)):
        line = np.zeros(len(row), dtype=np.int64)
        if kind in (0, 2):
            line = row + (above if kind == 2 else 0)
        else:
            left = corner = 0
            for x, v in enumerate(row.tolist()):
                up = int(above[x])
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                elif kind == 4:
                    guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
                else:
                    raise ValueError("unknown filter")
                left, corner = (v + guess) & 255, up
                line[x] = left
        above = line & 255
        out[y] = above
    return out


def samples(media: bytes) -> tuple[bytes, int]:
    """The samples of an 8-bit grey PNG, row by row, and the length its text chunk states."""
    if not media.startswith(PNG):
        raise ValueError("not a PNG")
    at, data, size, stated = len(PNG), [], None, None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            width, height, depth, colour, *_, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("8-bit grey without interlace is asked for")
            size = width, height
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            stated = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if size is None:
        raise ValueError("no header chunk")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    payload = unfiltered(rows).tobytes()
    return payload, len(payload) if stated is None else stated


def feature(payload: bytes) -> str:
    """Least, greatest, sum and sum of squares of the samples, and how often neighbours differ."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    return f"min={x.min()};max={x.max()};sum={x.sum()};squares={(x * x).sum()};changes={int((np.diff(x) != 0).sum())}"


def header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size, info.mode = size, 0o644
    return info.tobuf(tarfile.USTAR_FORMAT)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of the texts' UTF-8 bytes below ``folder``; their paths, bytes and members.

    A null text is an empty payload. Archives and their sync points are named after the task's partition
    and appear when whole, so a task that runs again replaces its files.
    """
    make_dir(folder)
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        task = TaskContext.get().partitionId()
        rows = rows_of(batches, "doc_id", "text")
        held = next(rows, None)
        number = 0
        while held is not None:
            path = f"{base}/part-{task:06d}-{number:04d}.tar"
            size = members = 0
            sync: list[int] = []
            with committed(fs, path) as stream:
                while held is not None and size < file_bytes:
                    media = png(held[1] or b"")
                    if not sync or size - sync[-1] >= SYNC_BYTES:
                        sync.append(size)
                    member = header(f"{held[0] if held[0] is not None else 'null'}.png", len(media)) + media + bytes(-len(media) % BLOCK)
                    stream.write(member)
                    size += len(member)
                    members += 1
                    held = next(rows, None)
                stream.write(bytes(2 * BLOCK))
            with committed(fs, path + ".sync") as stream:
                stream.write(json.dumps({"sync": sync, "end": size}).encode())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([members])], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cut(rows.mapInArrow(run, "path string, bytes long, members long"))


class Range(InputPartition):
    """Members of an archive from one sync point to another."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``: a row for each member of its tar archives."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "path string, offset long, name string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("tries", TRIES)))


class ArchiveReader(DataSourceReader):
    SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])

    def __init__(self, folder: str, tries: int):
        self.folder, self.tries = folder, tries

    def partitions(self) -> list[Range]:
        fs, _ = place(self.folder)
        synced = {p.removesuffix(".sync") for p, _ in files(self.folder, ".tar.sync")}
        out = []
        for path, size in files(self.folder, ".tar"):
            points = {"sync": [0], "end": size}  # an archive without sync points is one range
            if path in synced:
                with fs.open_input_stream(path + ".sync") as f:
                    points = json.loads(f.read())
            out += [Range(path, a, b) for a, b in zip(points["sync"], [*points["sync"][1:], points["end"]], strict=True)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            fs, _ = place(self.folder)
            rows = members(Ranges(fs, partition.path), partition.start, partition.end, self.tries)
            yield from bounded(((partition.path, *r) for r in rows), self.SCHEMA, 2000, lambda r: len(r[3] or b""), BATCH_BYTES)


def members(source: Ranges, start: int, end: int, tries: int) -> Iterator[tuple]:
    """(offset, name, media, error) of the tar members that begin in a range."""
    at = start
    while at < end:
        error = name = media = None
        step = BLOCK
        for left in range(tries - 1, -1, -1):
            try:
                head = source.read(at, BLOCK)
                if head == bytes(BLOCK) or not head:
                    return
                info = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape")
                step = BLOCK + -(-info.size // BLOCK) * BLOCK
                media = source.read(at + BLOCK, info.size)
                if len(media) != info.size:
                    raise OSError("member cut short")
                name, error = info.name, None
                break
            except (OSError, tarfile.TarError) as e:
                error, media = f"{type(e).__name__}: {e}", None
                if left:
                    source.reopen()
        if error is not None:  # on to the next block that is a member's header
            after = at + BLOCK
            while after < end and not is_header(source.read(after, BLOCK)):
                after += BLOCK
            step = after - at
        yield at, name, media, error
        at += step


def is_header(block: bytes) -> bool:
    try:
        tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
    except tarfile.TarError:
        return False
    return True


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").load(folder)


#: Names that tell an id: a long in decimal ASCII digits. Other names have none.
ID_NAME = re.compile(r"-?[0-9]{1,18}\..{3}", re.ASCII)


def features(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error``.

    Members that could not be read, or are no 8-bit grey PNG, keep their row with the error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])

    def digest(name: str | None, media: bytes | None, error: str | None) -> tuple:
        doc_id = int(name[:-4]) if name and ID_NAME.fullmatch(name) else None
        if error is None:
            try:
                payload, stated = samples(media)
                return doc_id, stated, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), None
            except (ValueError, struct.error, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
        return doc_id, *[None] * 7, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bounded((digest(*row) for row in rows_of(batches, "name", "media", "error")), schema)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("name", "media", "error").mapInArrow(run, kinds)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store the texts of ``docs`` as media in the shared folder, read them back and compute features."""
    spark = docs.sparkSession
    folder = shared_path(spark, "media")
    write(docs, folder)
    return features(read(spark, folder))
