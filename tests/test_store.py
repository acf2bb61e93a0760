import zipfile

import numpy as np
import pytest

from gridmill.sources import mat, npz, store
from tests.test_sources import _variable


def test_many_archives_of_a_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    sets = {f"{k}/set_{i}.npz": rng.normal(size=(20 + 7 * i, 3, 2)) for i, k in enumerate(("a", "a", "b", "c d"))}
    for i, (name, f) in enumerate(sets.items()):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (np.savez if i % 2 else np.savez_compressed)(tmp_path / name, f=f, u=-f)
    (tmp_path / "a" / "_hidden.npz").write_bytes(b"x")
    (tmp_path / "a" / "notes.txt").write_bytes(b"x")
    spark.dataSource.register(npz.NpzSource)
    for uri in (str(tmp_path), f"file://{tmp_path}".replace(" ", "%20")):
        df = spark.read.format("npz").option("rows", 10).load(uri)
        got = df.collect()
        assert len(got) == sum(map(len, sets.values()))
        for r in got:
            name = next(n for n in sets if r.file.endswith(n.rsplit("/", 1)[1]))
            assert r.f == sets[name][r.sample].ravel().tolist() and r.u == (-sets[name][r.sample]).ravel().tolist() and r.shape == [3, 2]
        # ranges of stored files, one task for each compressed one
        assert df.rdd.getNumPartitions() == 2 + sum(-(-len(f) // 10) for i, f in enumerate(sets.values()) if i % 2)
    assert store.found(str(tmp_path / "none"), ".npz") == []
    with pytest.raises(Exception, match="no file"):
        spark.read.format("npz").load(str(tmp_path / "none")).collect()
    np.savez(tmp_path / "b" / "odd.npz", f=np.zeros((3, 2)), u=np.zeros((4, 2)))
    with pytest.raises(Exception, match="different numbers"):
        spark.read.format("npz").load(str(tmp_path / "b")).collect()


def test_a_compressed_member_is_unpacked_once(tmp_path, monkeypatch):
    f = np.arange(3000 * 4, dtype=float).reshape(3000, 2, 2)
    np.savez_compressed(tmp_path / "x.npz", f=f, u=f)
    read, plain = [0], zipfile.ZipExtFile.read

    def counted(self, n=-1):
        out = plain(self, n)
        read[0] += len(out)
        return out

    monkeypatch.setattr(zipfile.ZipExtFile, "read", counted)
    reader = npz.NpzReader(str(tmp_path / "x.npz"), ["f", "u"], 100)
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 3000 and read[0] < 2 * f.nbytes * 1.02 + 4096


def test_large_samples_come_in_small_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(npz, "BYTES", 8 * 100 * 3)
    np.savez(tmp_path / "x.npz", f=np.zeros((20, 10, 10)))
    reader = npz.NpzReader(str(tmp_path / "x.npz"), ["f"], 7)
    assert [[b.num_rows for b in reader.read(p)] for p in reader.partitions()] == [[3, 3, 1], [3, 3, 1], [3, 3]]
    np.savez(tmp_path / "empty.npz", f=np.zeros((0, 4)))
    reader = npz.NpzReader(str(tmp_path / "empty.npz"), ["f"], 7)
    assert [b for p in reader.partitions() for b in reader.read(p)] == []


def test_mat_files_of_a_folder(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(5, 2, 3))
    for i in range(3):
        (tmp_path / f"{i}.mat").write_bytes(b" " * 124 + b"\x00\x01IM" + _variable("f", a + i) + _variable("other", a))
    got = mat.ingest(spark, [f"file://{tmp_path}"], ["f"], str(tmp_path / "out")).collect()
    assert len(got) == 15 and all(np.array_equal(r.f, (a[r["sample"]] + int(r.path[-5])).ravel()) for r in got)
    with pytest.raises(Exception, match="no field g"):
        mat.ingest(spark, [str(tmp_path / "0.mat")], ["g"], str(tmp_path / "no"))
    with pytest.raises(Exception, match="no file"):
        mat.ingest(spark, [str(tmp_path / "9.mat")], ["f"], str(tmp_path / "no"))
