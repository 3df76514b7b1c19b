"""Arrays, seals, bundles and resumed runs."""

import io

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from halyard.session import shared_path
from halyard.sources import arrays as A
from halyard.sources import seals as Z


def test_arrays_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    values, ids = rng.normal(size=(1000, 7)).astype("<f4"), np.arange(1000) * 3
    np.save(tmp_path / "plain.npy", values)
    frame = A.read_arrays(spark, f"file://{tmp_path}/plain.npy", rows=128)
    assert frame.rdd.getNumPartitions() == 8
    got = np.array([r["values"] for r in frame.orderBy("row").collect()])
    assert np.array_equal(got, values.astype(float))
    for name, save in (("stored", np.savez), ("packed", np.savez_compressed)):
        folder = tmp_path / name
        folder.mkdir()
        save(folder / "x.npz", ids=ids, values=values, names=np.array(["é", "b"]))
        rows = A.aligned(A.read_arrays(spark, f"file://{folder}", "ids", 100), A.read_arrays(spark, f"file://{folder}", "values", 100)).orderBy("id").collect()
        assert [r.id for r in rows] == ids.tolist() and np.array_equal(np.array([r["values"] for r in rows]), values.astype(float))
        assert [r.text for r in A.read_arrays(spark, f"file://{folder}", "names").orderBy("row").collect()] == ["é", "b"]


def test_arrays_that_do_not_fit(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    np.savez(folder / "x.npz", ids=np.arange(5), values=np.zeros((4, 2)))
    with pytest.raises(Exception, match="differ in row 4"):
        A.aligned(A.read_arrays(spark, f"file://{folder}", "ids"), A.read_arrays(spark, f"file://{folder}", "values")).collect()
    np.save(tmp_path / "short.npy", np.zeros((100, 3)))
    whole = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends before row"):
        A.read_arrays(spark, f"file://{tmp_path}/short.npy").collect()
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="one or two dimensions"):
        A.read_arrays(spark, f"file://{tmp_path}/cube.npy").collect()
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert A.read_arrays(spark, f"file://{tmp_path}/none.npy").count() == 0


def test_written_arrays_of_lost_attempts_are_not_named(spark):
    frame = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(50)], "vec_id long, embedding array<float>").repartition(3)
    uri, names = A.write_arrays(frame, "vec_id", "embedding", rows=10)
    assert len(names) >= 5 and all(n.startswith("part-") for n in names)
    rows = A.aligned(A.read_arrays(spark, uri, "ids"), A.read_arrays(spark, uri, "values")).collect()
    assert sorted((r.id, r["values"][0]) for r in rows) == [(i, float(i)) for i in range(50)]


def sealed(spark, rows, uri):
    frame = rows.select(Z.row_hash("id", "x").alias("h")).agg(Z.digest().alias("d"), F.count("h").alias("n")).first()
    return Z.seal(spark, uri, {"digest": frame.d, "n": frame.n})


def test_a_seal_is_created_verified_and_defended(spark):
    folder = shared_path(spark, "seal")
    place, fs = Z.place(spark, folder)
    fs.mkdirs(place)
    uri = f"{folder}/p.json"
    rows = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(100)], "id long, x long")
    assert sealed(spark, rows, uri) == "created"
    assert sealed(spark, rows.repartition(7), uri) == "verified"
    before = Z.read_text(spark, uri)
    swapped = rows.withColumn("x", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("x")))
    for other in (swapped, rows.where("id <> 7"), rows.unionByName(rows.where("id = 7"))):
        with pytest.raises(Z.SealBroken):
            sealed(spark, other, uri)
    assert Z.read_text(spark, uri) == before


def test_bundles_keep_versions_and_refuse_damage(spark):
    root = shared_path(spark, "bundle")
    rows = spark.createDataFrame([(1,), (2,)], "x long")
    for factor in (2, 3):
        model = PipelineModel([SQLTransformer(statement=f"SELECT x, x * {factor} AS y FROM __THIS__")])
        Z.save_bundle(spark, root, lambda folder, m=model: m.write().save(folder), {"factor": factor})
    folder, metadata = Z.bundle(spark, root)
    assert metadata["factor"] == 3 and [r.y for r in PipelineModel.load(folder).transform(rows).orderBy("x").collect()] == [3, 6]
    newest = Z.pointer(spark, root)["current"]
    Z.roll_back(spark, root)
    folder, metadata = Z.bundle(spark, root)
    assert metadata["factor"] == 2 and Z.pointer(spark, root)["previous"] == newest
    Z.create_text(spark, f"{folder}/added", "damage")
    with pytest.raises(Z.SealBroken):
        Z.bundle(spark, root)
    Z.roll_back(spark, root)
    assert Z.bundle(spark, root)[1]["factor"] == 3
    with pytest.raises(LookupError):
        Z.roll_back(spark, shared_path(spark, "none"))


def test_a_resumed_run_equals_an_uninterrupted_one(spark):
    grid = spark.range(12).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    asked = []

    def evaluate(open_):
        asked.append(open_.count())
        return open_.select("run_id", (F.col("a") * 10 - F.col("b")).alias("metric"))

    cut, whole = Z.Runs(spark, shared_path(spark, "runs")), Z.Runs(spark, shared_path(spark, "runs"))
    cut.stage("s", grid.where("a < 5"), evaluate)
    cut.stage("s", grid, evaluate)
    cut.stage("s", grid.unionByName(grid), evaluate)
    whole.stage("s", grid, evaluate)
    assert asked == [5, 7, 12]
    assert sorted(map(tuple, cut.table().collect())) == sorted(map(tuple, whole.table().collect()))
    assert [r.metric for r in cut.best("s", 2).collect()] == [108.0, 99.0]
    assert Z.Runs(spark, shared_path(spark, "runs")).table().count() == 0


def test_header_of_both_versions():
    for version in ((1, 0), (2, 0)):
        out = io.BytesIO()
        np.lib.format.write_array(out, np.arange(6).reshape(3, 2), version=version)
        out.seek(0)
        shape, dtype, offset = A.header(out)
        assert shape == (3, 2) and dtype == np.dtype("<i8") and offset == len(out.getvalue()) - 48
