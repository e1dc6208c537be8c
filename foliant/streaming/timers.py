"""Stateful streams that act when time passes: sessions that end by themselves, tasks without a heartbeat."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.control import ACTIVE, SESSION_HOURS
from foliant.streaming.control import run_query

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 hour"
HEARTBEAT_MINUTES = 20.0


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk with timers, for the streams that start inside."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def _times(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """A key's rows of this batch in order of time: microseconds and the columns, no whole rows."""
    parts = [(r["ts"].astype("datetime64[us]").astype("int64").to_numpy(), *(r[c].to_numpy() for c in columns)) for r in rows]
    ts, *more = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((*reversed(more[:1]), ts))
    return list(zip(*(x[order].tolist() for x in (ts, *more))))


class _Sessions(StatefulProcessor):
    """One open session a client: when it opened, its events, and a timer at its end."""

    def __init__(self, hours: float):
        self.life = int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "opened long, n long")

    def _end(self, opened: int) -> int:
        return math.ceil((opened + self.life) / 1000)

    def _row(self, key: tuple, opened: int, n: int) -> tuple:
        return key[0], pd.Timestamp(opened, unit="us"), n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, n = self.session.get() or (None, 0)
        before, out = opened, []
        for (ts,) in _times(rows):
            if opened is None or ts >= opened + self.life:
                if opened is not None:
                    out.append(self._row(key, opened, n))
                opened, n = ts, 0
            n += 1
        if opened != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(opened))
        self.session.update((opened, n))
        if out:
            yield pd.DataFrame(out, columns=["client", "opened_at", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, n = self.session.get()
        self.session.clear()
        yield pd.DataFrame([self._row(key, opened, n)], columns=["client", "opened_at", "n"])

    def close(self) -> None:
        pass


def sessions(logins: DataFrame, hours: float = SESSION_HOURS, late: str = LATE) -> DataFrame:
    """(client, opened_at, n) of every session of a stream of (client, ts), when it ends.

    A session lasts ``hours`` from its first event; use does not renew it. It ends with the first
    event after it or when the watermark passes its end, and then leaves the state. Events more than
    ``late`` behind the newest one may be dropped.
    """
    return logins.withWatermark("ts", late).groupBy("client").transformWithStateInPandas(
        _Sessions(hours), "client string, opened_at timestamp, n long", "append", "eventTime"
    )


class _Heartbeats(StatefulProcessor):
    """The last event of each active task, and a timer at which it counts as lost."""

    def __init__(self, minutes: float):
        self.most = int(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, kind string")

    def _timer(self, ts: int) -> int:
        return (ts + self.most) // 1000 + 1  # an event at just this time is still a heartbeat

    def _row(self, key: tuple, ts: int, kind: str) -> tuple:
        return key[0], pd.Timestamp(ts, unit="us"), "requeued" if kind == "ingest" else "failed"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        last, out = held, []
        for ts, _, kind, status in _times(rows, "seq", "type", "status"):
            if last is not None and ts > last[0] + self.most:
                out.append(self._row(key, *last))
                last = None
            if last is None or ts >= last[0]:
                last = (ts, kind) if status in ACTIVE else None
        if last != held:
            if held is not None:
                self.handle.deleteTimer(self._timer(held[0]))
            if last is None:
                self.last.clear()
            else:
                self.last.update(last)
                self.handle.registerTimer(self._timer(last[0]))
        if out:
            yield pd.DataFrame(out, columns=["task_id", "last_seen", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield pd.DataFrame([self._row(key, *last)], columns=["task_id", "last_seen", "action"])

    def close(self) -> None:
        pass


def lost_tasks(events: DataFrame, minutes: float = HEARTBEAT_MINUTES, late: str = LATE) -> DataFrame:
    """(task_id, last_seen, action) of a stream of task events (task_id, seq, type, status, ts).

    A task that is pending or processing and has no event for more than ``minutes`` is lost: an
    ingest is requeued, any other fails. It says so once, when a later event or the watermark
    shows that the time is over; a task that ends, or is lost, leaves the state.
    """
    return events.withWatermark("ts", late).groupBy("task_id").transformWithStateInPandas(
        _Heartbeats(minutes), "task_id string, last_seen timestamp, action string", "append", "eventTime"
    )


def lost_tasks_batch(events: DataFrame, until, minutes: float = HEARTBEAT_MINUTES) -> DataFrame:
    """The same of a table, as known at the time ``until``."""
    most = F.make_dt_interval(secs=F.lit(minutes * 60.0))
    following = F.lead("ts").over(Window.partitionBy("task_id").orderBy("ts", "seq"))
    over = F.col("ts") + most
    lost = F.col("status").isin(*ACTIVE) & F.when(F.col("next").isNull(), over < until).otherwise(F.col("next") > over)
    action = F.when(F.col("type") == "ingest", "requeued").otherwise("failed")
    return events.withColumn("next", following).where(lost).select("task_id", F.col("ts").alias("last_seen"), action.alias("action"))


def run(stream: DataFrame, name: str) -> DataFrame:
    """Run such a stream over all that is there now."""
    with rocksdb(stream.sparkSession):
        return run_query(stream, name)
