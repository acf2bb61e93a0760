import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.sources import mat, npz, readers
from gridmill.streaming import epochs


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_source(spark, tmp_path, save):
    f, u = np.random.default_rng(0).normal(size=(10, 3, 4)), np.arange(120, dtype=np.float32).reshape(10, 3, 4)
    save(tmp_path / "a.npz", f=f, u=u, bad=np.arange(3))
    spark.dataSource.register(npz.NpzSource)
    got = spark.read.format("npz").option("fields", "f,u").option("rows", 4).load(str(tmp_path / "a.npz")).orderBy("sample").collect()
    assert len(got) == 10 and got[7].shape == [3, 4]
    assert np.array_equal(got[7].f, f[7].ravel()) and np.array_equal(got[9].u, u[9].ravel())
    for name in ("bad", "none"):
        with pytest.raises(npz.FieldError):
            npz.member(str(tmp_path / "a.npz"), name)
    with pytest.raises(npz.FieldError):
        npz.member(str(tmp_path / "b.npz"), "f")


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _variable(name: str, a: np.ndarray, cls: int = 6, flags: int = 0) -> bytes:
    kind = {"f8": 9, "f4": 7, "i2": 3, "i8": 12}[a.dtype.str[1:]]
    parts = _element(6, struct.pack("<II", cls | flags, 0)) + _element(5, np.array(a.shape, "<i4").tobytes()) + _element(1, name.encode()) + _element(kind, a.tobytes(order="F"))
    return _element(14, parts)


def test_mat_files(spark, tmp_path):
    a, b = np.random.default_rng(1).normal(size=(5, 2, 3)), np.arange(30, dtype="<i2").reshape(5, 2, 3)
    packed = zlib.compress(_variable("sol", b, 10))
    body = _variable("coeff", a) + struct.pack("<II", 15, len(packed)) + packed
    (tmp_path / "a.mat").write_bytes(b" " * 124 + b"\x00\x01IM" + body)
    assert np.array_equal(mat.field(str(tmp_path / "a.mat"), "coeff"), a) and np.array_equal(mat.field(str(tmp_path / "a.mat"), "sol"), b)
    got = mat.ingest(spark, [str(tmp_path / "a.mat")], ["coeff", "sol"], str(tmp_path / "out")).orderBy("sample").collect()
    assert len(got) == 5 and np.array_equal(got[3].coeff, a[3].ravel()) and got[3].sol == b[3].ravel().tolist()
    for name, bad in (("c", _variable("c", a, 6, 0x0800)), ("l", _variable("l", np.arange(4).reshape(2, 2), 14))):
        (tmp_path / "b.mat").write_bytes(b" " * 124 + b"\x00\x01IM" + bad)
        with pytest.raises(npz.FieldError):
            mat.field(str(tmp_path / "b.mat"), name)


def test_metrics_files(spark, tmp_path):
    for run, rows in (("a_17", "0,1.0,2.0,3.0,0.001,\n1,1,2,3,0.001,4.5\n"), ("b_18", "0,1,2,3,0.1\n")):
        os.makedirs(tmp_path / run)
        (tmp_path / run / "metrics.csv").write_text("epoch,train_mse,train_l2,test_l2,current_lr,epoch_time_s\n" + rows)
    got = readers.read_metrics(spark, str(tmp_path / "*/metrics.csv")).orderBy("run", "epoch").collect()
    assert [(r.run, r.epoch, r.epoch_time_s) for r in got] == [("a_17", 0, None), ("a_17", 1, 4.5), ("b_18", 0, None)]
    for _ in range(2):  # appended lines are read back, header and all
        readers.append_metrics(spark.createDataFrame(got), str(tmp_path / "appended"))
    back = readers.read_metrics(spark, str(tmp_path / "appended")).orderBy("run", "epoch").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in got for _ in range(2)]
    (tmp_path / "b_18" / "metrics.csv").write_text("head\n0,1,2,3,0.1\n1,x,2,3,0.1\n")
    with pytest.raises(ValueError, match="line 3 of run b_18"):
        readers.read_metrics(spark, str(tmp_path / "*/metrics.csv"))
    (tmp_path / "a_17" / "plot.png").write_bytes(b"x")
    (tmp_path / "a_17" / "weights.bin").write_bytes(b"x")
    files = readers.run_files(spark, str(tmp_path)).orderBy("run", "file").collect()
    assert [(r.name, r.started, r.file) for r in files] == [("a", 17, "metrics.csv"), ("a", 17, "plot.png"), ("b", 18, "metrics.csv")]


def test_records(spark, tmp_path):
    os.makedirs(tmp_path / "r_1")
    (tmp_path / "r_1" / "data_config.json").write_text(json.dumps({"base": {"n_train": 5, "n_test": 2}, "n": 65}))
    got = readers.run_data(readers.read_record(spark, str(tmp_path / "*/data_config.json"), readers.DATA)).first()
    assert (got.run, got.s, got.n_train, got.subset) == ("r_1", 64, 5, None)
    (tmp_path / "side.json").write_text(json.dumps({"n": 65, "s": 64, "K": 32, "seed": 7, "count": 200, "error2": {"mean": 1e-5, "max": 2e-5}}, indent=1))
    side = readers.sidecars(spark, str(tmp_path / "side.json")).first()
    assert (side.k, side.error2.max, side.label_check) == (32, 2e-5, None)
    stats = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [2], 1e-5)], readers.NORMALIZER)
    readers.write_normalizer(stats, str(tmp_path / "norm"))
    assert readers.read_normalizer(spark, str(tmp_path / "norm")).first() == stats.first()
    with pytest.raises(ValueError):
        readers.stage(64)


def test_written_split(spark, tmp_path):
    rows = spark.createDataFrame([(9, 4, s, i, [float(i)]) for s in ("train", "test") for i in range(3)], "n int, k int, split string, sample long, f array<double>")
    record = spark.createDataFrame([(9, 4, "train", 3)], "n int, k int, split string, count int")
    for part in (rows, rows.where("split = 'test'")):
        readers.write_split(part, record, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "fields")).count() == 6


def test_gn_steps(spark, tmp_path):
    os.makedirs(tmp_path / "r_1")
    names = [x.strip().split(" ")[0] for x in readers.GN_STEPS.split(",")]
    values = ["1", "2", *["0.5"] * 9, "true", "", "3", "0.1", "tol", "", "", "", "4", "5", "0.25"]
    (tmp_path / "r_1" / "gn_steps.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    got = readers.read_gn_steps(spark, str(tmp_path / "*/gn_steps.csv")).first()
    assert (got.accepted_iteration, got.ritz_min, got.forward_passes, got.run) == (None, None, 4, "r_1")
    steps = readers.read_gn_steps(spark, str(tmp_path / "*/gn_steps.csv"))
    for _ in range(2):
        readers.append_gn_steps(steps.drop("run"), str(tmp_path / "more"))
    assert readers.read_gn_steps(spark, str(tmp_path / "more")).drop("run").collect() == steps.drop("run").collect() * 2


def _epochs(spark, path, rows):
    spark.createDataFrame([(r, e, x, x, x, 0.1, 1.0, t) for r, e, x, t in rows], epochs.SCHEMA.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    path, at = str(tmp_path / "in"), "2024-01-01 00:0{}:00"
    _epochs(spark, path, [("a", 0, 3.0, at.format(0)), ("a", 1, 2.0, at.format(1)), ("b", 0, 5.0, at.format(1))])
    _epochs(spark, path, [("a", 1, 1.5, at.format(2)), ("a", 2, 1.0, at.format(3))])
    stream = epochs.epochs(spark, path, files_per_trigger=1)
    q = epochs.feed(stream).writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = epochs.feed(spark.read.parquet(path))
    assert sorted(spark.table("feed").collect()) == sorted(batch.collect())
    epochs.keep_latest(epochs.epochs(spark, path, files_per_trigger=1), str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
    for table in (epochs.latest_table(spark, str(tmp_path / "t")), epochs.compact(spark, str(tmp_path / "t"), str(tmp_path / "small"))):
        kept = table.orderBy("run", "epoch").collect()
        assert [(r.run, r.epoch, r.test_l2) for r in kept] == [("a", 0, 3.0), ("a", 1, 1.5), ("a", 2, 1.0), ("b", 0, 5.0)]
    q = epochs.totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.run, r.epochs, r.best) for r in spark.table("totals").collect()} == {("a", 4, 1.0), ("b", 1, 5.0)}
    known = spark.createDataFrame([("b",)], "run string")
    q = epochs.new_runs(stream, known).writeStream.format("memory").queryName("new").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.run for r in spark.table("new").collect()] == ["a"]
    seen = []
    epochs.on_epoch(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "c5")).awaitTermination()
    assert sum(seen) == 5
    q = epochs.without_repeats(stream.unionByName(epochs.epochs(spark, path))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c6")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 5


def test_compressed_members_of_either_header(spark, tmp_path):
    import io
    import zipfile

    import numpy as np

    from gridmill.sources import npz

    a = np.arange(700 * 6, dtype=float).reshape(700, 2, 3)
    path = str(tmp_path / "x.npz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, version in (("f", (1, 0)), ("u", (2, 0))):
            out = io.BytesIO()
            np.lib.format.write_array(out, a * (1 if name == "f" else -2), version)
            z.writestr(f"{name}.npy", out.getvalue())
    spark.dataSource.register(npz.NpzSource)
    got = spark.read.format("npz").option("rows", 300).load(path).orderBy("sample").collect()
    assert np.array_equal([r.f for r in got], a.reshape(700, 6)) and np.array_equal([r.u for r in got], -2 * a.reshape(700, 6))


def test_no_folder_of_one_machine_on_a_cluster():
    import pytest

    from gridmill.sources import shared

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Session())
