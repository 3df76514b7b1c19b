import json
import zipfile

import pytest
from pyspark.sql import functions as F

from halyard.sources import files as X
from halyard.sources import workbook as W

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>text</t></is></c><c r="C1" t="s"><v>1</v></c><c r="D1"/></row>
<row r="2"><c r="A2"><v>12.0</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c></row>
<row r="3"><c r="A3"/><c r="B3"/></row>
<row r="4"><c r="A4"><v>0.5</v></c><c r="C4" t="e"><v>#REF!</v></c></row></sheetData></worksheet>"""


def book(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>flag</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_workbook(spark, tmp_path):
    book(tmp_path / "b.xlsx")
    df = W.read_workbook(spark, str(tmp_path), ("id", "text"))
    assert df.columns == ["id", "text", "flag"]
    assert sorted(map(tuple, df.collect())) == [("0.5", None, None), ("12", "two runs", "true")]
    with pytest.raises(ValueError):
        W.read_workbook(spark, str(tmp_path), ("absent",))
    assert W.column_number("A1") == 0 and W.column_number("AA7") == 26


def test_event_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿request_id,status,entered_at\n7.0,open,2024-01-02 03:04:05\n8,open,45000\n9,,2024-01-01 00:00:00\n", encoding="utf-8")
    got = {r["request_id"]: str(r["entered_at"]) for r in X.read_event_log(spark, str(tmp_path / "log.csv")).collect()}
    assert got == {"7": "2024-01-02 03:04:05", "8": "2023-03-15 00:00:00"}


def test_aliases_and_staging(spark):
    df = spark.createDataFrame([("1", " short "), ("2", None), (None, None), (None, "a long enough text")], "`Ticket  ID` string, `DESC` string")
    named = X.by_alias(df, {"request_id": ("number", "ticket id"), "description": ("desc",), "service": ("svc",)})
    assert named.columns == ["request_id", "description", "service"]
    got = [(r["row_number"], r["state"], r["low_information"]) for r in X.staged(named, "b1").orderBy("row_number").collect()]
    assert got == [(2, "uploaded", True), (3, "failed", True), (4, "uploaded", False)]


def test_json_and_manifest(spark, tmp_path):
    X.write_lines(spark.createDataFrame([("x", "a"), (" ", "b"), ("y", None)], "text string, label string"), str(tmp_path / "s"))
    assert X.read_samples(spark, str(tmp_path / "s")).count() == 1
    (tmp_path / "r").mkdir()
    for i, s in enumerate(("complete", "failed")):
        (tmp_path / "r" / f"{i}.json").write_text(json.dumps({"status": s, "top1": 0.5}))
    (tmp_path / "r" / "bad.json").write_text("{oops")
    assert X.read_results(spark, str(tmp_path / "r"), "status string, top1 double").count() == 1
    assert X.hash_manifest(spark, str(tmp_path / "r")).count() == 3
    X.write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


def test_cache_computes_only_what_is_new(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    length = lambda d: d.select("key", F.length("text").alias("value"))
    all_rows, new = X.cached_scores(rows, None, length)
    assert all_rows.count() == 3 and new.count() == 2
    more, newer = X.cached_scores(rows.unionAll(spark.createDataFrame([("cc",)], "text string")), new, length)
    assert more.count() == 4 and newer.count() == 1


def test_written_workbooks(spark, tmp_path):
    rows = [(i, f" a<{i}>&\"b\" ", None if i % 3 else i / 7, i % 2 == 0) for i in range(25)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, x double, even boolean").coalesce(2)
    names = W.write_workbooks(df, f"file://{tmp_path}/w", "b", rows=10)
    assert len(names) == len(set(names)) >= 3 and names == sorted(names)
    got = {r["id"]: (r["text"], r["x"], r["even"]) for r in W.read_workbook(spark, f"{tmp_path}/w").collect()}
    want = {str(i): (t, x, e) for i, t, x, e in rows if i is not None}
    assert {k: (t, None if x is None else float(x), e == "true") for k, (t, x, e) in got.items()} == want
    kinds = {(r["name"], r["kind"]): r["n"] for r in W.cell_kinds(spark, f"file://{tmp_path}/w").collect()}
    assert kinds == {("id", "number"): 25, ("text", "inline"): 25, ("even", "boolean"): 25, ("x", "number"): 9, ("x", "empty"): 16}
    assert W.first_book(f"file://{tmp_path}/w").endswith(names[0])
    assert W.write_workbooks(df.limit(0), f"file://{tmp_path}/e") == []


def test_manifest_states(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    expected = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in X.verified(found, expected).collect()} == {"a": "same", "b": "changed", "c": "new", "d": "missing"}


def test_inventory_and_snapshot(spark, tmp_path):
    import hashlib

    from pyspark.sql import functions as F

    from halyard.sources import files as X

    named = {"a.txt": b"one", "models/big.bin": b"two", "models/x.zip": b"three", ".cache/y": b"four", "logs/z.txt": b"", "deep/logs2/w.txt": b"five"}
    for name, body in named.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    manifest = spark.createDataFrame([(f"file:{tmp_path}/{n}", len(b), hashlib.sha256(b).hexdigest()) for n, b in named.items()] + [("file:/elsewhere/a.txt", 1, "0" * 64)], "path string, length long, sha256 string")
    got = {r.relative: r.included for r in X.inventory(manifest, f"file://{tmp_path}", ("logs",), (".",), (".zip",)).collect()}
    assert got == {"a.txt": True, "models/big.bin": True, "models/x.zip": False, ".cache/y": False, "logs/z.txt": False, "deep/logs2/w.txt": True, None: False}
    assert all(r.included == (r.relative is not None) for r in X.inventory(manifest, str(tmp_path)).collect())
    found = X.hash_manifest(spark, str(tmp_path)).select("length", "sha256")
    assert {(r.length, r.sha256) for r in found.collect()} >= {(len(b), hashlib.sha256(b).hexdigest()) for n, b in named.items() if b and not n.startswith(".")}
    kept = X.inventory(manifest, f"file://{tmp_path}", ("logs",), (".",), (".zip",)).where("included")
    one, two = X.snapshot(kept).first(), X.snapshot(kept.orderBy(F.desc("relative")).repartition(3)).first()
    assert one == two and (one.files, one.bytes) == (3, 10)
    moved = kept.withColumn("relative", F.when(F.col("relative") == "a.txt", "b.txt").otherwise(F.col("relative")))
    assert X.snapshot(moved).first().sha256 != one.sha256
    assert X.snapshot(kept.limit(0)).first().files == 0
