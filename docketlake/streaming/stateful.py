"""Streams with state and timers: agents that fall silent, requests gathered into batches.

Rows wait in the state until the watermark has passed them and are then taken in order of time, so that the result
depends on the rows alone: neither on how they fell into micro-batches nor on their order within the delay. The
functions ``transitions`` and ``gathered`` give the same rows from a table. State lives per key, in the state store that
the session names; ``with_state_store`` asks for the one that timers need.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketlake.shipping import ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds without a beat after which an agent is offline; that a batch is open at most; rows of a batch.
SILENCE_MS, AGE_MS, SIZE = 300_000, 5_000, 10
STATUS = "key string, status string, at timestamp"
BATCH = "key string, opened timestamp, closed timestamp, reason string, n long, ids array<string>"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with a state store that keeps timers unless another was chosen."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def times(values: Iterable[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(list(values), unit="us"), dtype="datetime64[ns]")


class InOrder(StatefulProcessor):
    """Keeps rows (microseconds, id) until the watermark passes them; ``take`` gets each in order, ``wake`` the time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string")
        self.kept = handle.getValueState("kept", self.KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), i) for b in rows for at, i in zip(b["us"], b["id"])]
        yield from self.run(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.run(key, [], timerValues.getCurrentWatermarkInMs())

    def run(self, key, new: list[tuple[int, str]], watermark_ms: int) -> Iterator[pd.DataFrame]:
        until = watermark_ms * 1000
        rows = sorted([*((int(a), i) for a, i in (self.waiting.get() if self.waiting.exists() else ())), *new])
        state = self.kept.get() if self.kept.exists() else None
        out: list[tuple] = []
        due = [r for r in rows if r[0] <= until]
        for at, i in due:
            state = self.take(state, at, i, out)
        state, next_us = self.wake(state, until, out)
        left = rows[len(due) :]
        if left:
            self.waiting.put([tuple(r) for r in left])
            next_us = min(next_us, left[0][0]) if next_us else left[0][0]
        else:
            self.waiting.clear()
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if next_us:
            self.handle.registerTimer(max(-(-next_us // 1000), watermark_ms + 1))
        if out:
            yield self.frame(key, out)


class Silence(InOrder):
    """An agent is idle from a beat on, offline once it has been silent for too long."""

    KEPT = "last long, online boolean"

    def __init__(self, silence_ms: int = SILENCE_MS):
        self.silence = silence_ms * 1000

    def take(self, state, at, _, out):
        if state is not None and state[1] and at - state[0] > self.silence:
            out.append(("offline", state[0] + self.silence))
            state = (state[0], False)
        if state is None or not state[1]:
            out.append(("idle", at))
        return at, True

    def wake(self, state, until, out):
        if state is None or not state[1]:
            return state, None
        if until - state[0] > self.silence:
            out.append(("offline", state[0] + self.silence))
            return (state[0], False), None
        return state, state[0] + self.silence + 1

    def frame(self, key, out):
        return pd.DataFrame({"key": [str(key[0])] * len(out), "status": [s for s, _ in out], "at": times(a for _, a in out)})


class Gather(InOrder):
    """Rows of a key form batches: closed by their size, or by the age of the first."""

    KEPT = "opened long, ids array<string>"

    def __init__(self, size: int = SIZE, age_ms: int = AGE_MS):
        self.size, self.age = size, age_ms * 1000

    def take(self, state, at, i, out):
        if state is not None and at - state[0] >= self.age:
            out.append((state[0], state[0] + self.age, "age", list(state[1])))
            state = None
        ids = [*(state[1] if state else ()), i]
        opened = state[0] if state else at
        if len(ids) >= self.size:
            out.append((opened, at, "size", ids))
            return None
        return opened, ids

    def wake(self, state, until, out):
        if state is None:
            return None, None
        if until - state[0] >= self.age:
            out.append((state[0], state[0] + self.age, "age", list(state[1])))
            return None, None
        return state, state[0] + self.age

    def frame(self, key, out):
        return pd.DataFrame({"key": [str(key[0])] * len(out), "opened": times(o[0] for o in out), "closed": times(o[1] for o in out), "reason": [o[2] for o in out], "n": [len(o[3]) for o in out], "ids": [o[3] for o in out]})


def _run(rows: DataFrame, key: str, time: str, row_id: str, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    ship_package(with_state_store(rows.sparkSession))
    held = rows.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(row_id).cast("string").alias("id"))
    return held.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay).groupBy("key").transformWithStateInPandas(processor, schema, "Append", "eventTime")


def liveness(beats: DataFrame, key: str = "sender", time: str = "timestamp", row_id: str = "id", delay: str = "10 minutes", silence_ms: int = SILENCE_MS) -> DataFrame:
    """Stream of (key, status, at): idle when an agent is heard (again), offline once silent for over ``silence_ms``."""
    return _run(beats, key, time, row_id, delay, Silence(silence_ms), STATUS)


def batches(requests: DataFrame, key: str, time: str = "timestamp", row_id: str = "id", delay: str = "10 seconds", size: int = SIZE, age_ms: int = AGE_MS) -> DataFrame:
    """Stream of batches (key, opened, closed, reason, n, ids): flushed at ``size`` rows, or ``age_ms`` after the first.
    A key's rows are taken one after the other, so a kind with many rows is best split by a further part of its key."""
    return _run(requests, key, time, row_id, delay, Gather(size, age_ms), BATCH)


def transitions(beats: DataFrame, key: str, time: str, until, silence_ms: int = SILENCE_MS) -> DataFrame:
    """What ``liveness`` gives of a table once the watermark stands at ``until``."""
    silence = silence_ms * 1000
    us, end = F.unix_micros(F.col(time).cast("timestamp")), F.unix_micros(until)
    order = Window.partitionBy("key").orderBy("us")
    held = beats.select(F.col(key).cast("string").alias("key"), us.alias("us")).where(F.col("key").isNotNull() & (F.col("us") <= end)).withColumns({"before": F.lag("us").over(order), "after": F.lead("us").over(order)})
    heard = F.when(F.col("before").isNull() | (F.col("us") - F.col("before") > silence), F.struct(F.lit("idle").alias("status"), F.col("us").alias("at")))
    lost = F.when(F.coalesce(F.col("after"), end) - F.col("us") > silence, F.struct(F.lit("offline").alias("status"), (F.col("us") + silence).alias("at")))
    return held.select("key", F.explode(F.array_compact(F.array(heard, lost))).alias("x")).select("key", "x.status", F.timestamp_micros("x.at").alias("at"))


def written(stream: DataFrame, path: str, checkpoint: str):
    """Run a stream over what is there, appending to Parquet files; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
