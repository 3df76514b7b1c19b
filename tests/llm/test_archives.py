import gzip
import hashlib
import random
import zlib

import pyarrow.fs as pafs
import pytest

from halyard.llm import media as M
from halyard.llm import warc as W
from halyard.llm.store import Ranges


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'long page ' * 20}{i % 30}</p>") for i in range(90)] + [(200, None, None), (201, "u v\n", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", f"<p>{'long page ' * 20}0</p>"), (0, "http://h/0", f"<p>{'long page ' * 20}0</p>")]
    return rows, spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    got = W.round_trip(df).collect()
    assert len(got) == len(rows) and {r["kind"] for r in got} == {"record"}
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = len(h.encode()) >= 100 and i != first[h]
        want.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(want, key=str)
    assert W.round_trip(df.limit(0)).count() == 0


def archive(n=30, plain=False):
    rng = random.Random(1)
    parts = []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(0, 400)))
        r = W.record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), None, False)
        parts.append(r if plain else gzip.compress(r, mtime=0))
    return parts


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "none"])
def test_salvage(tmp_path, plain, damage):
    parts = archive(plain=plain)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    data = bytearray(b"".join(parts))
    lost = set()
    if damage == "flip":
        data[starts[7] + len(parts[7]) // 2] ^= 0xFF
        lost = {7}
    elif damage == "cut":
        del data[starts[29] + len(parts[29]) // 2 :]
        lost = {29}
    elif damage == "junk":
        data[starts[10] : starts[10]] = b"\x1f\x8b\x08WARC/1.1 no record at all" * 3
    (tmp_path / "x.warc").write_bytes(bytes(data))
    got = list(W.salvage(Ranges(pafs.LocalFileSystem(), str(tmp_path / "x.warc"), block=700)))
    ids = [int(r[3]["x-page-id"]) for r in got if r[0] == "record"]
    assert ids == [i for i in range(30) if i not in lost]
    gaps = [r for r in got if r[0] == "gap"]
    assert len(gaps) == (damage != "none") and sum(r[2] for r in got) == len(data)


def salvaged(tmp_path, data, keep=None):
    (tmp_path / "x.warc").write_bytes(bytes(data))
    return list(W.salvage(Ranges(pafs.LocalFileSystem(), str(tmp_path / "x.warc"), block=700), keep))


def test_several_records_in_a_member(tmp_path):
    parts = archive(plain=True)
    members = [gzip.compress(b"".join(parts[i : i + 6]), mtime=0) for i in range(0, 30, 6)]
    got = salvaged(tmp_path, b"".join(members))
    assert [int(r[3]["x-page-id"]) for r in got] == list(range(30)) and sum(r[2] for r in got) == sum(map(len, members))
    # a bad record inside a member, whose own checksum holds
    broken = bytearray(b"".join(parts[:6]))
    broken[len(parts[0]) + len(parts[1]) + len(parts[2]) - 20] ^= 0xFF
    got = salvaged(tmp_path, gzip.compress(bytes(broken), mtime=0) + members[1])
    assert [int(r[3]["x-page-id"]) for r in got if r[0] == "record"] == [0, 1, *range(3, 12)]
    assert [r[0] for r in got].count("gap") == 1
    # a member that breaks off: what was whole before stays
    whole = gzip.compress(b"".join(parts), mtime=0)
    got = salvaged(tmp_path, whole[: len(whole) // 2])
    ids = [int(r[3]["x-page-id"]) for r in got if r[0] == "record"]
    assert ids == list(range(len(ids))) and 10 < len(ids) < 30 and sum(r[2] for r in got) == len(whole) // 2


def lines(*header, block=b"", end=b"\r\n\r\n"):
    return b"WARC/1.0\r\n" + b"".join(h + b"\r\n" for h in header) + b"\r\n" + block + end


def test_long_headers_and_blocks_that_are_no_http(tmp_path):
    block = b"first line\r\n\r\nsecond part" * 10
    long = lines(b"WARC-Type: resource", b"X-Long: " + b"y" * 200_000, b"X-Page-Id: 5", b"Content-Type: text/plain", b"Content-Length: %d" % len(block), block=block)
    for data in (long, gzip.compress(long)):
        ((kind, _, _, header, facts),) = salvaged(tmp_path, data)
        assert kind == "record" and W.fields(header, facts, None)[:6] == ("resource", 5, None, None, hashlib.sha256(block).hexdigest(), len(block))
        assert facts["payload"] == block and len(header["x-long"]) == 200_000
    folded = lines(b"WARC-Type: metadata", b"X-A: one", b"\ttwo", b"WARC-Block-Digest: sha1:" + __import__("base64").b32encode(hashlib.sha1(b"abc").digest()), b"Content-Length: 3", block=b"abc")
    ((kind, _, _, header, facts),) = salvaged(tmp_path, folded)
    assert header["x-a"] == "one two" and facts["checked"]


def test_large_records_are_read_without_keeping_them(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "PIECE", 1000)
    payload = bytes(range(256)) * 400
    data = b"".join(W.record(i, "http://h", payload, hashlib.sha256(payload).hexdigest(), None, False) for i in range(3))
    for blob in (data, gzip.compress(data)):
        got = salvaged(tmp_path, blob, keep=10)
        assert [(r[0], r[4]["size"], r[4]["digest"], r[4]["payload"]) for r in got] == [("record", len(payload), hashlib.sha256(payload).hexdigest(), None)] * 3


@pytest.mark.parametrize("number", ["²129", "-5", "", "1" * 30, "12a"])
def test_malformed_numbers_are_damage_and_no_crash(tmp_path, number):
    good = archive(2, plain=True)
    bad = lines(b"WARC-Type: response", b"Content-Length: " + number.encode(), block=b"x" * 129)
    got = salvaged(tmp_path, good[0] + bad + good[1])
    assert [r[0] for r in got] == ["record", "gap", "record"]
    odd = lines(b"WARC-Type: resource", b"X-Page-Id: " + number.encode(), b"Content-Length: 1", block=b"x")
    ((_, _, _, header, facts),) = salvaged(tmp_path, odd)
    assert W.fields(header, facts, None)[1] == (-5 if number == "-5" else None)


@pytest.mark.parametrize("seed", range(6))
def test_random_damage_never_raises_and_lengths_add_up(tmp_path, seed):
    rng = random.Random(seed)
    parts = archive(20, plain=seed % 2 == 0)
    if seed >= 4:
        parts = [gzip.compress(b"".join(archive(20, plain=True)), mtime=0)]
    for _ in range(25):
        data = bytearray(b"".join(parts))
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(data))
            if rng.random() < 0.3:
                del data[at : at + rng.randint(1, 50)]
            elif rng.random() < 0.3:
                data[at:at] = rng.choice([b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"Content-Length: 9", bytes(rng.randrange(256) for _ in range(9))])
            else:
                data[at] = rng.randrange(256)
        got = salvaged(tmp_path, data)
        assert sum(r[2] for r in got) == len(data)
        for r in got:
            if r[0] == "record":
                W.fields(r[3], r[4], None)
        if seed < 4:
            assert sum(r[0] == "record" for r in got) >= 20 - 16


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    rows, df = pages(spark)
    folder = f"file://{tmp_path}"
    manifest = W.write(W.typed(df), folder)
    first = manifest.first()["path"].removeprefix("file://")
    (tmp_path / "part-000000-999999-0000.warc.gz").write_bytes(open(first, "rb").read())
    assert W.read_files(manifest).count() == len(rows) < W.read(spark, folder).count()


def test_media_round_trip(spark):
    texts = ["plain", None, "", "é" * 1000, "x" * 64, "y" * 65, "plain", "z" * 200_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "null id", "k")], "doc_id long, text string, error string")
    got = {r["doc_id"]: r for r in M.round_trip(df).collect()}
    assert len(got) == 9 and all(r["error"] is None for r in got.values())
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    same = lambda r: tuple(r)[1:]
    assert same(got[0]) == same(got[6]) and same(got[1]) == same(got[2])
    assert M.round_trip(df.limit(0)).count() == 0


def test_ranges_cover_each_member_once_and_failures_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SYNC_BYTES", 2000)
    folder = f"file://{tmp_path}"
    df = spark.range(50).selectExpr("id AS doc_id", "repeat(cast(id AS string), 400) AS text").coalesce(1)
    M.write(df, folder)
    parts = M.ArchiveReader(folder, 2).partitions()
    assert len(parts) >= 1
    path = parts[0].path
    data = bytearray(open(path, "rb").read())
    names = [n for _, n, *_ in M.members(Ranges(pafs.LocalFileSystem(), path), 0, len(data), 2)]
    assert names == [f"{i}.png" for i in range(50)]
    data[512 * 4] ^= 0xFF  # in a header or an image
    open(path, "wb").write(bytes(data))
    rows = M.features(M.read(spark, folder)).collect()
    assert sum(r["error"] is not None for r in rows) == 1 and sum(r["error"] is None for r in rows) == 49


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    import numpy as np

    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (5, 7))
    rows = np.zeros((5, 8), dtype=np.uint8)
    for y in range(5):
        rows[y, 0] = kind
        for x in range(7):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            rows[y, x + 1] = (image[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (M.unfiltered(rows) == image).all()


def test_many_gaps_in_a_member_take_linear_time(tmp_path):
    import time

    parts = [W.record(i, None, b"payload %d" % i, "0", None, False) for i in range(8000)]
    took = []
    for n in (1000, 4000):
        bad = [p if i % 2 else p.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload") for i, p in enumerate(parts[: 2 * n])]
        start = time.process_time()
        got = salvaged(tmp_path, gzip.compress(b"".join(bad), mtime=0))
        took.append(time.process_time() - start)
        assert [int(r[3]["x-page-id"]) for r in got if r[0] == "record"] == list(range(1, 2 * n, 2))
        assert [r[0] for r in got].count("gap") == n
    assert took[1] < 10 * took[0] + 1


def test_a_failed_record_that_was_too_long_to_keep(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "REPLAY", 3000)
    monkeypatch.setattr(W, "PIECE", 512)
    parts = archive(n=12, plain=True)
    big = W.record(50, None, b"x" * 40_000, "0", None, False).replace(b"xxx\r\n\r\n", b"xxy\r\n\r\n")
    got = salvaged(tmp_path, gzip.compress(b"".join([*parts[:5], big, *parts[5:], big]), mtime=0))
    assert [int(r[3]["x-page-id"]) for r in got if r[0] == "record"] == list(range(12)) and [r[0] for r in got].count("gap") == 2


def test_large_members_are_streamed(tmp_path, monkeypatch):
    parts = archive(n=30, plain=True)
    data = gzip.compress(b"".join(parts), mtime=0)
    held = salvaged(tmp_path, data)
    cut_off = salvaged(tmp_path, data[: len(data) // 2])
    monkeypatch.setattr(W, "HOLD", 2000)
    assert salvaged(tmp_path, data) == held and len(held) == 30
    assert salvaged(tmp_path, data[: len(data) // 2]) == cut_off


def test_http_headers_of_any_line_ends(tmp_path):
    http = {"Content-Type": "application/http; msgtype=response"}

    def block(body):
        head = "".join(f"{k}: {v}\r\n" for k, v in {**http, "Content-Length": len(body)}.items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"

    bodies = [b"HTTP/1.1 200 OK\nContent-Length: 4\n\nbody", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", b"no header at all", b"", b"HTTP/1.1 200 OK\r\nA: b\r\n", b"z" * (3 << 20)]
    got = salvaged(tmp_path, b"".join(map(block, bodies)))
    assert [r[4]["payload"] for r in got] == [b"body", b"body", bodies[2], b"", bodies[4], bodies[5]]
    assert [r[4]["size"] for r in got] == [4, 4, len(bodies[2]), 0, len(bodies[4]), 3 << 20] and got[0][4]["http_length"] == 4


def test_member_names_that_are_no_ids(spark):
    rows = [(name, b"", "unread") for name in ("12.png", "-3.png", "².png", "1²3.png", "١٢.png", "x.png", ".png", None, "9" * 30 + ".png")]
    got = M.features(spark.createDataFrame(rows, "name string, media binary, error string")).collect()
    assert [r.doc_id for r in got] == [12, -3, None, None, None, None, None, None, None] and all(r.error == "unread" for r in got)
