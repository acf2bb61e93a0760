import random

import pytest

from gridmill.sources import store
from gridmill.streaming import segments

SCHEMA = "run string, epoch int, loss double, ts int"


def brute(batches):
    out = {}
    for rows in batches:
        for run, epoch, loss, ts in rows:
            out[run, epoch] = max(out.get((run, epoch), (-1, -1.0)), (ts, loss))
    return sorted((run or "", epoch, loss, ts) for (run, epoch), (ts, loss) in out.items())


def got(spark, path, run=None):
    return sorted((r.run or "", r.epoch, r.loss, r.ts) for r in segments.table(spark, path, run).collect())


def made(n):
    rng = random.Random(n)
    return [[(rng.choice(["a", "b", "c", "d", None]) if i else f"only{k}", rng.randrange(6), float(rng.randrange(9)), rng.randrange(50)) for i in range(8)] for k in range(n)]


def test_tables_equal_sorting_and_stay_in_few_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    monkeypatch.setattr(segments, "FILE_ROWS", 5)
    path, batches = str(tmp_path / "t"), made(14)
    with pytest.raises(ValueError):
        segments.table(spark, path)
    for k, rows in enumerate(batches):
        segments.add(spark.createDataFrame(rows, SCHEMA), k, path)
    assert got(spark, path) == brute(batches)
    state = segments.manifest(path)
    # 14 batches: 1 of nine, 1 of three, 2 of one
    assert sorted(s["level"] for s in state["segments"]) == [0, 0, 1, 2]
    # one run is looked for in few of the files
    every = segments._files(spark, state, state["segments"])
    some = segments._files(spark, state, state["segments"], "only13")
    assert len(some) <= 2 * len(state["segments"]) < len(every)
    assert got(spark, path, "only13") == [x for x in brute(batches) if x[0] == "only13"] != []
    assert got(spark, path, "b") == [x for x in brute(batches) if x[0] == "b"] and got(spark, path, "zz") == []
    # folders that were merged two batches ago are gone
    assert len(list((tmp_path / "t" / "segments").iterdir())) <= len(state["segments"]) + len(state["dropped"])


def test_a_crash_between_data_and_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 2)
    path, batches = f"file://{tmp_path}/t", made(4)
    for k, rows in enumerate(batches[:3]):
        segments.add(spark.createDataFrame(rows, SCHEMA), k, path)
    before = got(spark, path)
    plain = store.replace

    def crash(uri, data):
        raise OSError("lost")

    monkeypatch.setattr(store, "replace", crash)
    with pytest.raises(OSError):
        segments.add(spark.createDataFrame(batches[3], SCHEMA), 3, path)
    assert got(spark, path) == before == brute(batches[:3])
    monkeypatch.setattr(store, "replace", plain)
    for _ in range(2):  # the batch comes again, and once more
        segments.add(spark.createDataFrame(batches[3], SCHEMA), 3, path)
        assert got(spark, path) == brute(batches)


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    segments.add(spark.createDataFrame([], SCHEMA), 0, path)
    assert got(spark, path) == [] and segments.manifest(path)["segments"] == []
    segments.add(spark.createDataFrame([("a", 1, 2.0, 3)], SCHEMA), 1, path)
    assert got(spark, path) == [("a", 1, 2.0, 3)]
