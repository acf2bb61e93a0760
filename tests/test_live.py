import os

import pytest
from pyspark.sql import functions as F

from gridmill.sources import live, readers
from gridmill.streaming import epochs

HEAD = ",".join(readers.METRICS) + "\n"


def put(root, run, text, mode="a"):
    os.makedirs(f"{root}/{run}", exist_ok=True)
    with open(f"{root}/{run}/metrics.csv", mode) as f:
        f.write(text)


def rows(*epochs_, loss=1.0):
    return "".join(f"{e},{loss},{loss},{loss},0.001,{e}.5\n" for e in epochs_)


class Feed:
    """A query into a table of files that is started anew for each trigger."""

    def __init__(self, spark, root, at, **more):
        self.spark, self.root, self.at, self.more = spark, root, at, more

    def go(self):
        got = live.live_metrics(self.spark, self.root, **self.more)
        q = got.writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.run, r.epoch, r.train_l2) for r in self.spark.read.parquet(f"{self.at}/out").collect())


def test_appended_rows_are_read_once_and_after_restarts(spark, tmp_path):
    root, feed = str(tmp_path / "runs"), Feed(spark, str(tmp_path / "runs"), str(tmp_path))
    put(root, "a_1", HEAD + rows(0, 1))
    put(root, "run=b%3A2", HEAD)
    assert feed.go() == [("a_1", 0, 1.0), ("a_1", 1, 1.0)]
    put(root, "a_1", rows(2) + "3,1.0,1.0,1")  # half a line waits
    put(root, "run=b%3A2", rows(0))
    put(root, "c", "")
    assert feed.go() == [("a_1", 0, 1.0), ("a_1", 1, 1.0), ("a_1", 2, 1.0), ("b:2", 0, 1.0)]
    put(root, "a_1", ".0,0.001,\n\n")
    put(root, "c", HEAD.replace("\n", "\r\n") + rows(7).replace("\n", "\r\n"))
    got = feed.go()
    batch = readers.read_metrics(spark, f"{root}/*/metrics.csv").select("run", "epoch", "train_l2")
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 6
    assert feed.go() == got


def test_a_running_query_sees_what_is_appended(spark, tmp_path):
    root = str(tmp_path / "runs")
    put(root, "a", HEAD + rows(0))
    q = live.live_metrics(spark, root).writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        for e in range(1, 4):
            put(root, "a", rows(e))
            put(root, f"r{e}", HEAD + rows(0, 1))
            q.processAllAvailable()
            assert spark.table("running").count() == 1 + 3 * e
    finally:
        q.stop()


def test_a_resumed_run_replaces_its_later_epochs(spark, tmp_path):
    root, at = str(tmp_path / "runs"), str(tmp_path)

    def go():
        epochs.keep_latest(live.live_metrics(spark, root), f"{at}/table", f"{at}/c").awaitTermination()
        return {(r.run, r.epoch): r.train_l2 for r in epochs.latest_table(spark, f"{at}/table").collect()}

    put(root, "a", HEAD + rows(0, 1, 2, 3))
    assert set(go().values()) == {1.0}
    put(root, "a", HEAD + rows(0, 1) + rows(2, 3, 4, 5, loss=0.5), "w")
    os.utime(f"{root}/a/metrics.csv", (2e9, 2e9))
    assert go() == {("a", 0): 1.0, ("a", 1): 1.0, **{("a", e): 0.5 for e in range(2, 6)}}
    put(root, "a", HEAD + rows(0), "w")
    os.utime(f"{root}/a/metrics.csv", (3e9, 3e9))
    assert len(go()) == 6


def test_bad_rows(spark, tmp_path):
    root = str(tmp_path / "runs")
    put(root, "a", HEAD + rows(0) + "x,1,1\n" + rows(1))
    assert Feed(spark, root, str(tmp_path / "kept"), keep_bad=True).go() == [("a", 0, 1.0), ("a", 1, 1.0)]
    with pytest.raises(Exception, match="byte .* of run a: x,1,1"):
        Feed(spark, root, str(tmp_path / "failed")).go()


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_lines_belong_to_one_slice(tmp_path, monkeypatch, size):
    monkeypatch.setattr(live, "TASK_BYTES", size)
    monkeypatch.setattr(live, "BACK", 5)
    root = str(tmp_path)
    put(root, "a", HEAD + rows(*range(30)))
    put(root, "b", HEAD + rows(*range(5)) + "no end")
    reader = live.LiveReader(root, "metrics.csv")
    parts = reader.partitions(reader.initialOffset(), end := reader.latestOffset())
    got = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert sorted(got) == sorted((rows(*range(30)) + rows(*range(5))).split())
    assert reader.partitions(end, end) == [] and reader.latestOffset() == end
    put(root, "b", "\n")
    more = reader.partitions(end, reader.latestOffset())
    assert [v for p in more for b in reader.read(p) for v in b.column("value").to_pylist()] == ["no end"]


def test_times_of_change_order_rows(spark, tmp_path):
    root = str(tmp_path / "runs")
    put(root, "a", HEAD + rows(0))
    os.utime(f"{root}/a/metrics.csv", (1_700_000_000, 1_700_000_000))
    q = live.live_metrics(spark, f"file://{root}").select(F.unix_timestamp("ts").alias("t")).writeStream.format("memory").queryName("times").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.t for r in spark.table("times").collect()] == [1_700_000_000]
