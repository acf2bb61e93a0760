import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from functools import partial
from math import isnan

import pyarrow as pa
import pytest
from pyspark.sql import Row

from gridmill.streaming import open_runs

SCHEMA = "run string, epoch int, test_l2 double, epoch_time_s double, ts timestamp"


@pytest.fixture(scope="module")
def own(spark):
    return open_runs.state_session(spark)


class Following:
    """Batches of rows, (run, epoch, loss, hour) each, put through a query that is started anew for each."""

    def __init__(self, own, path, known=None):
        self.own, self.path, self.known, self.n, self.query = own, str(path), known, 0, None

    def put(self, *rows):
        self.own.createDataFrame([(r, e, x, 1.0, f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00") for r, e, x, h in rows], SCHEMA.replace("timestamp", "string")).selectExpr("run", "epoch", "test_l2", "epoch_time_s", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.own.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
        got = open_runs.followed(stream, self.known, "1 hour", 6 * 3600, 48 * 3600)
        self.query = got.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/c").trigger(availableNow=True).start()
        self.query.awaitTermination()
        all_ = self.own.read.schema(got.schema).parquet(f"{self.path}/out").collect()
        new, self.n = len(all_) - self.n, len(all_)
        return sorted((r.run, r.kind, r.epochs, r.best, r["last"]) for r in all_), new

    def kept(self):
        return [op["numRowsTotal"] for p in self.query.recentProgress for op in json.loads(p.json)["stateOperators"]][-1]


def test_runs_open_close_and_are_forgotten(own, tmp_path):
    f = Following(own, tmp_path)
    got, _ = f.put(("a", 0, 3.0, 0), ("a", 1, 2.0, 1), ("b", 0, 5.0, 1))
    assert got == [("a", "create", 0, None, None), ("a", "totals", 2, 2.0, 2.0), ("b", "create", 0, None, None), ("b", "totals", 1, 5.0, 5.0)]
    got, _ = f.put(("a", 2, 2.5, 4))
    assert ("a", "totals", 3, 2.0, 2.5) in got and not [r for r in got if r[1] == "close"]
    # b is silent for over six hours
    got, _ = f.put(("a", 3, 1.0, 9))
    assert [r for r in got if r[1] == "close"] == [("b", "close", 1, 5.0, 5.0)]
    # and goes on with its totals when it is resumed
    got, new = f.put(("b", 1, 4.0, 10), ("a", 4, None, 10))
    assert ("b", "continue", 1, 5.0, 5.0) in got and ("b", "totals", 2, 4.0, 4.0) in got and ("a", "totals", 5, 1.0, None) in got and new == 3
    # rows behind the watermark are dropped
    assert f.put(("a", 0, 0.1, 2), ("z", 0, 0.1, 2))[1] == 0
    # after two days without rows nothing is left of either
    f.put(("c", 0, 1.0, 100))
    f.put(("c", 1, 1.0, 101))
    assert f.kept() == 1
    got, _ = f.put(("a", 9, 7.0, 102))
    assert [r for r in got if r[:2] == ("a", "create")] == [("a", "create", 0, None, None)] * 2


def test_known_runs_are_continued(own, tmp_path):
    known = own.createDataFrame([("a", 5, 1.0, 1.5, 4, 10.0, "2024-01-01 00:00:00"), ("q", 1, 1.0, 1.0, 0, None, None)], "run string, epochs int, best double, last double, last_epoch int, seconds double, seen string")
    f = Following(own, tmp_path, known)
    got, _ = f.put(("a", 5, 2.0, 1), ("b", 0, 5.0, 1))
    assert got == [("a", "continue", 5, 1.0, 1.5), ("a", "totals", 6, 1.0, 2.0), ("b", "create", 0, None, None), ("b", "totals", 1, 5.0, 5.0)]


def test_a_restart_changes_nothing(own, tmp_path):
    rows = [("r%d" % (i % 3), i // 3, float(i % 7), i // 4) for i in range(24)]
    one, many = Following(own, tmp_path / "one"), Following(own, tmp_path / "many")
    whole = one.put(*rows)[0]
    for i in range(0, 24, 8):
        parts = many.put(*rows[i : i + 8])[0]
    last = lambda got: {r[0]: max(x for x in got if x[:2] == (r[0], "totals")) for r in got}
    assert last(whole) == last(parts)


class Calls:
    """A state and its handle in memory; every call is a message to the store in a real query."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return self.does(name, *args)

        return call

    def does(self, name, *args):
        match name:
            case "exists":
                return self.value is not None
            case "get":
                return self.value
            case "update":
                self.value = args[0]
            case "registerTimer":
                self.timers.add(args[0])
            case "deleteTimer":
                self.timers.remove(args[0])
            case "getValueState":
                return self


def test_a_run_costs_few_messages_and_holds_few_rows():
    store, held, most = Calls(), set(), 0
    zero, hour = datetime(1970, 1, 1, tzinfo=timezone.utc), 3_600_000

    class Live(Row):
        def __del__(self):
            held.discard(id(self))

    def rows(lo, hi):
        nonlocal most
        for i in range(lo, hi):
            r = Live("r", i, float(-i), 0.5 if i % 2 else None, zero + timedelta(hours=i // 1000))
            held.add(id(r))
            most = max(most, len(held))
            yield r

    runs = open_runs._Runs(6 * hour, 48 * hour)
    runs.init(store)
    store.calls.clear()
    got = [*runs.handleInputRows(("r",), rows(0, 20_000), None)]
    assert [(r.kind, r.epochs, r.best, r["last"], r.last_epoch, r.seconds) for r in got] == [("create", 0, None, None, None, None), ("totals", 20_000, -19_999.0, -19_999.0, 19_999, 5_000.0)]
    assert len(store.calls) == 3 and store.timers == {25 * hour}
    got = [*runs.handleInputRows(("r",), rows(20_000, 20_001), None)]
    assert [(r.kind, r.epochs, r.seconds) for r in got] == [("totals", 20_001, 5_000.0)]
    assert len(store.calls) == 8 and store.timers == {26 * hour}
    # late rows leave the timer as it is
    assert [r.last_epoch for r in runs.handleInputRows(("r",), rows(5, 6), None)] == [20_000]
    assert len(store.calls) == 11 and store.timers == {26 * hour}
    assert most <= 2 * open_runs.PART + 2


def test_losses_that_are_no_numbers_count_as_in_sql(own, tmp_path):
    nan = float("nan")
    f = Following(own, tmp_path)
    got, _ = f.put(("a", 0, 3.0, 0), ("a", 1, nan, 1), ("b", 0, nan, 0), ("b", 1, None, 1), ("c", 0, None, 0))
    last = {r[0]: r[2:] for r in got if r[1] == "totals"}
    assert last["a"][:2] == (2, 3.0) and isnan(last["a"][2])
    assert isnan(last["b"][1]) and last["b"][2] is None and last["c"] == (1, None, None)


def test_times_are_instants_in_any_zone(own, tmp_path):
    zone = own.conf.get("spark.sql.session.timeZone")
    own.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        f = Following(own, tmp_path)
        f.put(("a", 0, 3.0, 5))
        path = f"{tmp_path}/out"
        assert own.read.parquet(path).selectExpr("unix_seconds(seen)").distinct().collect() == own.read.parquet(f"{tmp_path}/in").selectExpr("unix_seconds(ts)").collect()
    finally:
        own.conf.set("spark.sql.session.timeZone", zone)


def test_rows_that_time_cannot_part_come_to_the_state_as_one(own, tmp_path, monkeypatch):
    class Counted(open_runs._Runs):
        def handleInputRows(self, key, rows, timerValues):
            for run, n in Counter(r["run"] for r in rows).items():
                yield self._row("rows", (run, n, None, None, None, None, 0, True))

    monkeypatch.setattr(open_runs, "_Runs", Counted)
    f = Following(own, tmp_path)
    # nothing can be late in the first batch; later, rows of a time are late together
    got, _ = f.put(*(("r%d" % (i % 2), i, 1.0, i // 8) for i in range(96)))
    assert [r[:3] for r in got] == [("r0", "rows", 1), ("r1", "rows", 1)]
    got, _ = f.put(*(("s", i, 1.0, 20 + i // 8) for i in range(32)))
    assert [r[:3] for r in got if r[0] == "s"] == [("s", "rows", 4)]


def test_late_rows_are_dropped_beside_rows_in_time(own, tmp_path):
    f = Following(own, tmp_path)
    f.put(("a", 0, 3.0, 0), ("a", 1, 2.0, 20))
    got, _ = f.put(("a", 2, 1.0, 5), ("a", 3, 4.0, 20), ("a", 4, 5.0, 21), ("b", 0, 9.0, 5))
    assert max(r for r in got if r[1] == "totals") == ("a", "totals", 4, 2.0, 5.0) and not [r for r in got if r[0] == "b"]


def test_joined_rows_have_the_totals_of_their_rows(monkeypatch):
    nan, hour = float("nan"), 3_600_000_000
    names = ["run", "epoch", "test_l2", "epoch_time_s", "ts"]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.timestamp("us", "UTC")]
    draw = random.Random(5)
    rows = [(draw.randrange(9), draw.choice([None, 0, 1, 2, 3]), draw.choice([None, nan, draw.random()]), draw.choice([None, 0.5]), (i * 7 % 600 - 2) * hour) for i in range(600)]
    rows += [(9, 0, nan, None, hour), (9, None, nan, None, 2 * hour), (10, None, None, None, hour)]

    def state(parts):
        out = {}
        for run in sorted({p[0] for p in parts}):
            runs = open_runs._Runs(1, 1)
            runs.init(Calls())
            out[run] = [*runs.handleInputRows((run,), iter([p for p in parts if p[0] == run]), None)][-1]
        return repr(out)

    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    plain = [(*r[:4], zero + timedelta(microseconds=r[4])) for r in rows]
    one = pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    one = one.append_column(pa.field("n", pa.int64(), nullable=False), pa.array([1] * len(rows))).append_column("least", one["test_l2"]).append_column("at", one["ts"])
    monkeypatch.setattr(open_runs, "JOINED", 64)
    for first in (False, True):
        monkeypatch.setattr(open_runs, "TaskContext", type("Task", (), {"get": lambda: type("At", (), {"getLocalProperty": lambda name: "0" if first else "1"})}))
        got = pa.Table.from_batches([*open_runs._in_parts(iter(one.to_batches(max_chunksize=10)))])
        assert got.schema == one.schema and (got.num_rows < 40) == first
        assert state([tuple(r.values()) for r in got.to_pylist()]) == state(plain)
    early = sum(r[4] <= 0 for r in rows)
    assert early == 3 and open_runs._joined(one, True).num_rows == len({r[0] for r in rows if r[4] > 0}) + early


def test_runs_of_one_bucket_close_and_are_forgotten_each_in_its_time(own, tmp_path, monkeypatch):
    monkeypatch.setattr(open_runs, "followed", partial(open_runs.followed, buckets=1))
    f = Following(own, tmp_path)
    f.put(("a", 0, 1.0, 0), ("b", 0, 2.0, 2), ("c", 0, 3.0, 2))
    got, _ = f.put(("c", 1, 2.0, 8))
    assert [r[0] for r in got if r[1] == "close"] == ["a"]
    # the watermark is at the eighth hour, where b has been silent for six
    got, _ = f.put(("c", 2, 1.0, 9))
    assert [r[0] for r in got if r[1] == "close"] == ["a", "b"]
    f.put(("c", 3, 1.0, 50))
    # a is forgotten, b is not
    got, _ = f.put(("a", 1, 1.0, 50), ("b", 1, 1.0, 50))
    assert [r[:3] for r in got if r[1] in ("create", "continue")] == [("a", "create", 0), ("a", "create", 0), ("b", "continue", 1), ("b", "create", 0), ("c", "create", 0)]
    assert sorted(r[:3] for r in got if r[1] == "totals" and r[0] in "ab") == [("a", "totals", 1), ("a", "totals", 1), ("b", "totals", 1), ("b", "totals", 2)]
