"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The reader checks every record: the gzip member's own checksum, the version line, the header, the
lengths and the block digest. When a check fails it searches onwards for the next place where a member
or a version line begins and a whole record follows, takes up there, and reports the bytes between as a
quarantined gap. A member may hold any number of records, and the search goes on inside it. So one
damaged byte costs one record where each has its member, and nothing is lost without a trace. There is
no limit to the length of headers and records; what is not kept is read piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import bounded, rows_of
from halyard.llm.store import Ranges, committed, files, make_dir, place
from halyard.session import cut, shared_path

LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
PIECE = 1 << 20
#: Bytes of a record that are kept so that they can be read again when it fails, of a member's records that are held until
#: its end is known, and of an HTTP header.
REPLAY, HOLD, HTTP_HEADER = 8 << 20, 64 << 20, 1 << 20
HEADER_END = re.compile(rb"\r?\n\r?\n")
DATE = "2024-01-01T00:00:00Z"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(Exception):
    """A record that fails a check."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record, which has the HTTP header and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    header = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        header.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if page_id is not None:
        header.append(("X-Page-Id", str(page_id)))
    if revisit:
        header += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    header += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in header).encode() + b"\r\n" + block + b"\r\n\r\n"


class Content:
    """Bytes that are pulled in pieces: a stretch of a file, or what a gzip member holds."""

    def __init__(self, pull: Callable[[], bytes]):
        self.pull, self.ended, self.at = pull, False, 0
        self.buffer, self.pos = b"", 0
        self.marked: int | None = None

    @property
    def ahead(self) -> int:
        return len(self.buffer) - self.pos

    def need(self, n: int) -> bool:
        """Hold so many bytes ahead; whether there are as many."""
        if self.ahead < n and not self.ended:
            if self.marked is not None and self.pos - self.marked > REPLAY:
                self.marked = None
            start = self.pos if self.marked is None else self.marked
            parts, total = [self.buffer[start:]], self.ahead
            while total < n and not self.ended:
                parts.append(self.pull())
                total += len(parts[-1])
                self.ended = not parts[-1]
            self.buffer, self.pos = b"".join(parts), self.pos - start
            self.marked = None if self.marked is None else 0
        return self.ahead >= n

    def take(self, n: int) -> bytes:
        self.need(n)
        out = self.buffer[self.pos : self.pos + n]
        self.pos += len(out)
        self.at += len(out)
        return out

    def find(self, what: bytes, start: int = 0) -> int:
        """Where it stands in the bytes held ahead, from ``start`` on; -1 if nowhere."""
        return max(self.buffer.find(what, self.pos + start) - self.pos, -1)

    def mark(self) -> None:
        """Keep what is taken from here on, as long as it has no more than ``REPLAY`` bytes."""
        self.marked = self.pos

    def rewind(self) -> bool:
        """Go back to the mark; False if that is too far."""
        if self.marked is None:
            return False
        self.at -= self.pos - self.marked
        self.pos, self.marked = self.marked, None
        return True


def plain(source: Ranges, offset: int) -> Content:
    """The bytes of a file from an offset on."""
    at = offset

    def pull() -> bytes:
        nonlocal at
        piece = source.read(at, PIECE)
        at += len(piece)
        return piece

    return Content(pull)


class Member:
    """A gzip member, decompressed piece by piece; ``length`` is its compressed length once it is read."""

    def __init__(self, source: Ranges, offset: int):
        self.source, self.offset = source, offset
        self.reopen()

    def reopen(self) -> None:
        """Start again at the first byte of the content."""
        self.at = self.offset
        self.unzip, self.fed = zlib.decompressobj(31), b""
        self.failure: str | None = None
        self.content = Content(self.pull)

    def pull(self) -> bytes:
        while not self.unzip.eof and self.failure is None:
            block = self.fed or self.source.read(self.at, 1 << 16)
            if not self.fed:
                self.at += len(block)
            if not block:
                self.failure = "member cut short"
                break
            try:
                out = self.unzip.decompress(block, PIECE)
            except zlib.error as e:
                self.failure = f"member: {e}"
                break
            self.fed = self.unzip.unconsumed_tail
            if out:
                return out
        return b""

    @property
    def length(self) -> int:
        return self.at - len(self.unzip.unused_data) - self.offset


def header_of(content: Content) -> dict[str, str]:
    """The header of the record that comes next: the version line, then lines of any number and length."""
    content.need(len(VERSION))
    if not content.buffer.startswith(VERSION, content.pos):
        raise Damaged("no version line")
    header: dict[str, str] = {}
    last, first = None, True
    while True:
        seen = 0
        while (end := content.find(b"\r\n", seen)) < 0:
            seen = max(0, content.ahead - 1)
            if not content.need(content.ahead + 1):
                raise Damaged("header without end")
        line = content.take(end + 2)[:-2]
        if first:
            if not re.fullmatch(rb"WARC/1\.[0-9]+", line):
                raise Damaged("no version line")
            first = False
        elif not line:
            return header
        elif line[:1] in b" \t" and last is not None:
            header[last] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, colon, value = line.partition(b":")
            if not colon:
                raise Damaged("header line without colon")
            last = name.strip().lower().decode("utf-8", "replace")
            header[last] = value.strip().decode("utf-8", "replace")


class Digest:
    """A stated digest, in hexadecimal or base 32, of bytes that come in pieces; unknown kinds are not checked."""

    def __init__(self, stated: str | None):
        kind, _, self.value = (stated or "").partition(":")
        kind = kind.strip().lower().replace("-", "")
        self.known = kind in ("md5", "sha1", "sha256", "sha512")
        self.sum = hashlib.new(kind) if self.known else None

    def update(self, piece: bytes) -> None:
        if self.sum is not None:
            self.sum.update(piece)

    def differs(self) -> bool:
        return self.known and self.value.strip().lower() not in (self.sum.hexdigest(), base64.b32encode(self.sum.digest()).decode().lower().rstrip("="), base64.b32encode(self.sum.digest()).decode().lower())


def record_of(content: Content, keep: int | None = None, ends_at=None) -> tuple[dict[str, str], dict]:
    """Header and facts of the record that comes next, all checks passed.

    Facts: ``size`` and ``digest`` of the payload, the payload itself if it has no more than ``keep``
    bytes (None: always), ``checked`` if the block had a digest that holds, ``http_length``. The block is
    read piece by piece, so a record of any length takes no more memory than what is kept of it. The
    payload is what follows the HTTP header, whatever its line ends, or else the whole block: also where the
    type says HTTP but no header ends within ``HTTP_HEADER`` bytes.
    """
    header = header_of(content)
    length = header.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damaged("no length")
    left = int(length)
    if ends_at is not None and not ends_at(content.at + left):
        raise Damaged("length and end differ")
    http = header.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    stated, payload = Digest(header.get("warc-block-digest")), hashlib.sha256()
    kept: list[bytes] = []
    before, size, inside = bytearray(), 0, not http
    while left:
        piece = content.take(min(left, PIECE))
        if not piece:
            raise Damaged("record cut short")
        left -= len(piece)
        stated.update(piece)
        if not inside:
            seen = max(0, len(before) - 3)
            before += piece
            end = HEADER_END.search(before, seen)
            if end:
                before, piece, inside = before[: end.start()], bytes(before[end.end() :]), True
            elif left and len(before) <= HTTP_HEADER:
                continue
            else:
                before, piece, inside = bytearray(), bytes(before), True
        size += len(piece)
        payload.update(piece)
        if keep is None or size <= keep:
            kept.append(piece)
    if content.take(4) != b"\r\n\r\n":
        raise Damaged("length and end differ")
    if stated.differs():
        raise Damaged("block digest differs")
    lengths = [int(m) for m in re.findall(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", before)]
    whole = b"".join(kept) if keep is None or size <= keep else None
    return header, {"size": size, "digest": payload.hexdigest(), "payload": whole, "checked": stated.known, "http_length": lengths[0] if lengths else None}


def salvage(source: Ranges, keep: int | None = None) -> Iterator[tuple]:
    """("record", offset, length, header, facts) and ("gap", offset, length, reason, None), in order.

    Lengths add up to the file. Of several records in a gzip member the first has the member's offset and
    length, the others its offset and length 0; so has a damaged stretch between them. Of a member that
    breaks off, records with a block digest that holds are kept (length 0) and its bytes are a gap.
    """
    at, lost, reason = 0, None, ""

    def follows(offset: int) -> Callable[[int], bool]:
        return lambda end: source.read(offset + end, 4) == b"\r\n\r\n"

    while at < source.size:
        start = source.read(at, 8)
        found: Iterable[tuple] = ()
        try:
            if start.startswith(GZIP):
                found, member = records_of(source, at, keep)
                if member.failure is not None:
                    raise Damaged(member.failure)
                if isinstance(found, list) and not any(kind == "record" for kind, *_ in found):
                    raise Damaged(found[0][1] if found else "empty member")
                length = member.length
            elif start.startswith(VERSION):
                content = plain(source, at)
                header, facts = record_of(content, keep, follows(at))
                found, length = [("record", header, facts)], content.at
            else:
                raise Damaged("neither member nor version line")
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            for kind, header, facts in found:
                if kind == "record" and facts["checked"]:
                    yield "record", at, 0, header, facts
            at = next_candidate(source, at + 1)
            continue
        if lost is not None:
            yield "gap", lost, at - lost, reason, None
            lost = None
        for i, (kind, header, facts) in enumerate(found):
            yield kind, at, 0 if i else length, header, facts
        at += length
    if lost is not None:
        yield "gap", lost, source.size - lost, reason, None


def records_of(source: Ranges, at: int, keep: int | None) -> tuple[Iterable[tuple], Member]:
    """What a member holds, and the member read to its end, which tells its length and whether it breaks off.

    Records are held until that is known, ``HOLD`` bytes at most; of a larger member nothing is held, it is
    read once for its end and then again, record by record.
    """
    member, found, size = Member(source, at), [], 0
    for item in member_records(member, keep):
        found.append(item)
        size += 500 + len((item[2] or {}).get("payload") or b"")
        if size > HOLD:
            whole = Member(source, at)
            deque(member_records(whole, 0), maxlen=0)
            return member_records(Member(source, at), keep), whole
    return found, member


def member_records(member: Member, keep: int | None) -> Iterator[tuple]:
    """("record", header, facts) and ("gap", reason, None) inside a member; a gap ends where a whole record follows.

    A failed record is given back and searched from its second byte on; only one that took more than ``REPLAY`` bytes makes
    the member be decompressed again up to there.
    """
    while member.content.need(1):
        content, start = member.content, member.content.at
        content.mark()
        try:
            header, facts = record_of(content, keep)
        except Damaged as e:
            if member.failure is not None:
                return
            if not content.rewind():
                member.reopen()
                content = member.content
                while content.at < start:
                    content.take(min(PIECE, start - content.at))
            more = resume(content)
            yield "gap", f"{e}, at {f'bytes {start} to {content.at}' if more else f'byte {start}'} of the member's content", None
            if not more:
                return
        else:
            yield "record", header, facts


def resume(content: Content) -> bool:
    """Move on to the next version line; False at the end of the content."""
    content.take(1)
    while True:
        found = content.find(VERSION)
        if found >= 0:
            content.take(found)
            return True
        content.take(max(0, content.ahead - len(VERSION) + 1))
        if not content.need(content.ahead + 1):
            content.take(content.ahead)
            return False


def next_candidate(source: Ranges, at: int) -> int:
    """Where the next gzip member or version line may begin."""
    while at < source.size:
        window = source.read(at, (1 << 20) + 8)
        found = [i for i in (window.find(GZIP), window.find(VERSION)) if i >= 0]
        if found:
            return at + min(found)
        at += max(1, len(window) - 7)
    return source.size


def typed(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id, url, payload, digest, refers_to, revisit``.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the smallest non-null page_id is the response
    (all rows with it, if it is repeated); the others revisit it. A null html is an empty payload; where
    all ids of a payload are null, all are responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of typed rows below ``folder``; their paths, bytes and records. A member a record.

    A file's name has its task's attempt in it, and the returned rows are those of the attempts that
    count: files of an attempt that was lost or superseded are in none of them.
    """
    make_dir(folder)
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        task = TaskContext.get()
        rows = rows_of(batches, "page_id", "url", "payload", "digest", "refers_to", "revisit")
        held = next(rows, None)
        number = 0
        while held is not None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
            size = records = 0
            with committed(fs, f"{base}/{name}") as stream:
                while held is not None and size < file_bytes:
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(*held)) + squeeze.flush()
                    stream.write(member)
                    size += len(member)
                    records += 1
                    held = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([size]), pa.array([records])], schema=schema)

    return cut(pages.mapInArrow(run, "path string, bytes long, records long"))


RECORD = "kind string, path string, offset long, length long, reason string, record_type string, page_id long, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, folder: str, suffix: str = ".warc.gz", keep_bytes: int | None = None) -> DataFrame:
    """:func:`read_files` of all archives below ``folder``."""
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    paths = [(f"{scheme}{p}" if scheme == "file://" or not scheme else folder.rstrip("/") + p[len(place(folder)[1].rstrip("/")) :],) for p, _ in files(folder, suffix)]
    return read_files(spark.createDataFrame(paths, "path string"), keep_bytes)


def read_files(paths: DataFrame, keep_bytes: int | None = None) -> DataFrame:
    """All records and gaps of the archives in ``path``; a file is a task, which holds one payload at a time.

    ``kind`` is ``record`` or ``gap``; a gap has path, offset, length and reason only. A response's payload
    digest and size are those of the payload read, a revisit's are those that its headers state. Payloads
    of more than ``keep_bytes`` are null, with their digest and size (0: no payloads; None: all of them,
    which then must fit a row); records of any length are read.
    """
    schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (path,) in rows_of(batches, "path"):
                source = Ranges(*place(path))
                for kind, offset, length, header, facts in salvage(source, keep_bytes):
                    if kind == "gap":
                        yield (kind, path, offset, length, header, *[None] * 7)
                    else:
                        yield (kind, path, offset, length, None, *fields(header, facts, keep_bytes))
                source.close()

        yield from bounded(rows(), schema, 2000, lambda r: len(r[-1] or b""))

    listed = paths.select("path")
    return listed.repartition(max(1, min(listed.count(), 10_000))).mapInArrow(run, RECORD)


def fields(header: dict[str, str], facts: dict, keep_bytes: int | None) -> tuple:
    def number(name: str) -> int | None:
        value = header.get(name, "")
        return int(value) if re.fullmatch("-?[0-9]{1,19}", value) and -(1 << 63) <= int(value) < 1 << 63 else None

    if header.get("warc-type") == "revisit":
        digest, size, payload = header.get("warc-payload-digest", "").partition(":")[2] or None, facts["http_length"], None
    else:
        digest, size, payload = facts["digest"], facts["size"], facts["payload"]
    return header.get("warc-type"), number("x-page-id"), number("x-refers-to-page"), header.get("warc-target-uri"), digest, size, payload if keep_bytes != 0 else None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, and read those files without their payloads.

    ``kind`` is ``record`` for all rows unless a file was damaged after it was written.
    """
    folder = shared_path(pages.sparkSession, "warc")
    return read_files(write(typed(pages), folder), keep_bytes=0)
