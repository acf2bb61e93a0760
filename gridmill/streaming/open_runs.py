"""Runs followed while they train, closed and forgotten by event time.

A run's first rows create it, or continue it if it is known; every batch of its epochs updates its
totals; a run that has been silent is closed. What stays of a closed run is its totals, so that it
goes on if it is resumed, until it is forgotten. The state so holds the runs of the last while, however
long the stream goes on.

Rows of a run that can't be told apart by their time are one row before they come to the state: in
every batch those of the same time; in a query's first batch, which no watermark precedes, all. What
lies there when a query starts so costs the state one row a run. Runs share the states of buckets, so
that messages to the store are as many as these."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that the state needs, and the setting that names it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_STATE = "runs array<struct<run: {run}, epochs: bigint, best: double, last: double, last_epoch: int, seconds: double, seen_ms: bigint, open: boolean>>"
OUT = "run {run}, kind string, epochs long, best double, last double, last_epoch int, seconds double, seen timestamp"
#: Places in a row of the stream, and in one that stands for many: it has their last epoch and loss, sum of
#: times, latest time, number, least loss and the time of the last epoch.
_EPOCH, _LOSS, _TIME, _TS, _N, _LEAST, _AT = 1, 2, 3, 4, 5, 6, 7
#: Rows that are handed to the state at once, and rows that a task joins at once.
PART, JOINED = 4096, 1 << 18
_ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _least(a: float | None, b: float | None) -> float | None:
    """Minimum as SQL has it: without nulls, and NaN only where nothing else is."""
    return b if a is None or (a != a and b is not None) else a if b is None or b != b else min(a, b)


def _sum(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else a + b


def _many(r: Row) -> tuple:
    """A row of the stream as one that stands for itself alone."""
    return r if len(r) > _N else (*r, 1, r[_LOSS], r[_TS])


def _both(a: tuple, b: tuple) -> tuple:
    """A row that stands for those of two of a run."""
    top = a if b[_EPOCH] is None or (a[_EPOCH] is not None and (a[_EPOCH], a[_AT]) >= (b[_EPOCH], b[_AT])) else b
    return (a[0], top[_EPOCH], top[_LOSS], _sum(a[_TIME], b[_TIME]), max(a[_TS], b[_TS]), a[_N] + b[_N], _least(a[_LEAST], b[_LEAST]), top[_AT])


def _joined(rows: pa.Table, first: bool) -> pa.Table:
    """One row for all those of a run and time; or of a run, if first, for all after 1970 begins."""
    schema, real = rows.schema, pc.if_else(pc.is_nan(rows["least"]), None, rows["least"])
    rows = rows.append_column("real", real)
    if first:
        later = pc.greater(rows["ts"].cast(pa.int64()), 0)
        rows = rows.append_column("own", pc.if_else(later, None, rows["ts"]))
    else:
        rows = rows.append_column("own", rows["ts"])
    # the last row of a run is that of its last epoch, the newest of several; rows without an epoch come before
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("run", "own", "epoch", "at")], null_placement="at_start"))
    last = pc.ScalarAggregateOptions(skip_nulls=False)
    found = rows.group_by(["run", "own"], use_threads=False).aggregate(
        [*((c, "last", last) for c in ("epoch", "test_l2", "at")), ("epoch_time_s", "sum"), ("ts", "max"), ("n", "sum"), ("real", "min"), ("least", "max")]
    )
    # the greatest of losses is one that is no number if there is nothing else
    out = {"run": found["run"], "epoch": found["epoch_last"], "test_l2": found["test_l2_last"], "epoch_time_s": found["epoch_time_s_sum"], "ts": found["ts_max"]}
    out |= {"n": found["n_sum"], "least": pc.coalesce(found["real_min"], found["least_max"]), "at": found["at_last"]}
    return pa.table(out, schema)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows joined, JOINED of them at once; those that stay many go on."""
    # a query's first batch has no watermark that could part a run's rows
    first = TaskContext.get().getLocalProperty("streaming.sql.batchId") == "0"
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= JOINED:
            rows = _joined(pa.Table.from_batches(held), first)
            held, n = rows.to_batches(PART), rows.num_rows
            if n > JOINED // 2:
                yield from held
                held, n = [], 0
    if n:
        yield from _joined(pa.Table.from_batches(held), first).to_batches(PART)


class _Runs(StatefulProcessor):
    """The runs of a bucket. idle_ms: silence after which a run is closed; forget_ms: and after which it is forgotten."""

    def __init__(self, idle_ms: int, forget_ms: int, run: str = "string"):
        self.idle_ms, self.forget_ms, self.run = idle_ms, forget_ms, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("runs", _STATE.format(run=self.run))

    def _row(self, kind: str, s: tuple) -> Row:
        return Row(run=s[0], kind=kind, epochs=s[1], best=s[2], last=s[3], last_epoch=s[4], seconds=s[5], seen=_ZERO + timedelta(milliseconds=s[6]))

    def _expiry(self, s: tuple) -> int:
        """When a run of this state is closed or forgotten."""
        return s[6] + (self.idle_ms if s[7] else self.forget_ms)

    def _first(self, states: dict[object, tuple]) -> int | None:
        """When a bucket wakes, for the first of its runs: it has one timer, so none need be looked up."""
        return min(map(self._expiry, states.values()), default=None)

    def _states(self) -> dict[object, tuple]:
        return {s[0]: tuple(s) for s in self.state.get()[0]} if self.state.exists() else {}

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        rows = [[r[c] for c in ("run", "epochs", "best", "last", "last_epoch", "seconds", "seen_ms")] for r in initialState["known"]]
        if states := {r[0]: (*r, False) for r in rows if r[6] is not None}:
            self.state.update(([*states.values()],))
            self.handle.registerTimer(self._first(states))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: dict[object, tuple] = {}
        for r in map(_many, rows):
            found[r[0]] = _both(found[r[0]], r) if r[0] in found else r
        states = self._states()
        timer = self._first(states)
        for run, r in found.items():
            seen, s = (r[_TS] - _ZERO) // timedelta(milliseconds=1), states.get(run)
            was = s or (run, 0, None, None, None, None, seen, False)
            if not was[7]:
                yield self._row("create" if s is None else "continue", was)
            _, epochs, best, last, last_epoch, seconds, before, _ = was
            if r[_EPOCH] is not None and (last_epoch is None or r[_EPOCH] >= last_epoch):
                last, last_epoch = r[_LOSS], r[_EPOCH]
            states[run] = (run, epochs + r[_N], _least(best, r[_LEAST]), last, last_epoch, _sum(seconds, r[_TIME]), max(before, seen), True)
            yield self._row("totals", states[run])
        self.state.update(([*states.values()],))
        if timer != (now := self._first(states)):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, states = expiredTimerInfo.getExpiryTimeInMs(), self._states()
        for run, s in [*states.items()]:
            # a run's time has come as a timer's has: once the watermark is there
            if self._expiry(s) > max(at, timerValues.getCurrentWatermarkInMs()):
                continue
            if s[7]:
                yield self._row("close", s)
            states[run] = (*s[:7], False)
            # the timer that woke the bucket is no more
            if not s[7] or self._expiry(states[run]) <= at:
                del states[run]
        if states:
            self.state.update(([*states.values()],))
            self.handle.registerTimer(self._first(states))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def followed(rows: DataFrame, known: DataFrame | None = None, late: str = "1 hour", idle_s: int = 6 * 3600, forget_s: int = 30 * 86400, buckets: int = 1 << 14) -> DataFrame:
    """Changes of runs as their epochs come in, for the append mode.

    rows: a stream of (run, epoch, test_l2, epoch_time_s, ts); rows later than `late` behind the newest
    are dropped, as are rows without a run or time. known: a table (run, epochs, best, last,
    last_epoch, seconds, seen) of runs from before, which are continued and not created.
    Returns (run, kind, epochs, best, last, last_epoch, seconds, seen): `create` or `continue` when a
    run begins or goes on, `totals` after each batch of its rows, `close` after idle_s without one. A
    run is forgotten forget_s after its last row. The session's state store must be STORE. Runs share the
    state of one of so many buckets, which is read and written as a whole; their number and a query's
    checkpoint belong together."""
    kind = rows.schema["run"].dataType.simpleString()
    cols = [F.col("epoch").cast("int").alias("epoch"), F.col("test_l2").cast("double").alias("test_l2"), F.col("epoch_time_s").cast("double").alias("epoch_time_s")]
    stream = rows.where(F.col("run").isNotNull() & F.col("ts").isNotNull()).select("run", *cols, F.col("ts").cast("timestamp").alias("ts"))
    stream = stream.withColumns({"n": F.lit(1).cast("long"), "least": F.col("test_l2"), "at": F.col("ts")}).repartition("run")
    bucket = F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int")
    stream = stream.mapInArrow(_in_parts, stream.schema).withWatermark("ts", late).withColumn("bucket", bucket)
    first = None
    if known is not None:
        plain = [F.col("epochs").cast("long").alias("epochs"), *(F.col(c).cast("double").alias(c) for c in ("best", "last")), F.col("last_epoch").cast("int").alias("last_epoch"), F.col("seconds").cast("double").alias("seconds")]
        rows_ = known.where(F.col("run").isNotNull()).select(F.col("run").cast(kind).alias("run"), *plain, F.unix_millis(F.col("seen").cast("timestamp")).alias("seen_ms"))
        first = rows_.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct(*rows_.columns)).alias("known")).groupBy("bucket")
    return stream.groupBy("bucket").transformWithState(_Runs(idle_s * 1000, forget_s * 1000, kind), OUT.format(run=kind), "Append", "EventTime", initialState=first)


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same context whose state store is STORE; the given one is left as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(*STORE)
    return own
