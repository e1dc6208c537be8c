"""Stateful control operators as batch plans: task states, queue, recovery, rate limits, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY, REFILL = 40.0, 20.0
SESSION_HOURS = 24
ACTIVE = ("pending", "processing")


def stage_logs(events: DataFrame) -> DataFrame:
    """Fold task events (task_id, seq, status, stage, message, progress, at) into each task's state.

    The log is all entries in order of seq; status, progress and error are those of the last,
    with 100 for completed and the message as error for failed.
    """
    entry = F.struct("seq", "stage", "message", "progress", "at")
    last = F.max_by(F.struct("status", "progress", "message", "stage"), "seq")
    folded = events.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("log"), last.alias("last"))
    return folded.select(
        "task_id",
        F.col("last.status").alias("status"),
        F.when(F.col("last.status") == "completed", 100).otherwise(F.col("last.progress")).alias("progress"),
        F.when(F.col("last.status") == "failed", F.col("last.message")).otherwise("").alias("error_msg"),
        F.col("last.stage").alias("stage"),
        F.transform("log", lambda e: e.dropFields("seq")).alias("stages_log"),
    )


def final_states(events: DataFrame) -> DataFrame:
    """The same without the logs: combined before the shuffle, so a task with many events is one row a map task."""
    last = F.max_by(F.struct("status", "progress", "stage"), "seq")
    done = events.groupBy("task_id").agg(last.alias("last"), F.count("*").alias("n_events"))
    progress = F.when(F.col("last.status") == "completed", 100).otherwise(F.col("last.progress"))
    return done.select("task_id", "last.status", progress.alias("progress"), "last.stage", "n_events")


def book_states(books: DataFrame, tasks: DataFrame) -> DataFrame:
    """Books after their ingest tasks' events: progress means processing, failure failed, completion ready.

    Tasks of other types never change a book.
    """
    state = (
        F.when(F.col("status") == "completed", "ready").when(F.col("status") == "failed", "failed").otherwise("processing")
    )
    last = tasks.where(F.col("type") == "ingest").groupBy("book_id").agg(F.max_by(state, "created_at").alias("new"))
    return books.join(last, "book_id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def dispatch(tasks: DataFrame, cap: int = 1) -> DataFrame:
    """The queued ingest tasks that start now: the oldest, as many as the cap leaves room for."""
    cap = max(cap, 1)
    ingest = F.col("type") == "ingest"
    running = tasks.where(ingest & F.col("dispatched_at").isNotNull() & F.col("status").isin(*ACTIVE)).agg(
        F.count("*").alias("running")
    )
    queued = tasks.where(ingest & (F.col("status") == "pending") & F.col("dispatched_at").isNull())
    oldest = queued.orderBy("created_at", "task_id").limit(cap)  # never more than the cap
    numbered = oldest.withColumn("place", F.row_number().over(Window.orderBy("created_at", "task_id")))
    return numbered.join(F.broadcast(running), how="cross").where(F.col("place") <= cap - F.col("running")).drop("running")


def recover(tasks: DataFrame) -> DataFrame:
    """Orphans of a lost worker: ingests are queued again from 0, summaries fail; others stay."""
    orphan = F.col("status").isin(*ACTIVE)
    again, lost = orphan & (F.col("type") == "ingest"), orphan & (F.col("type") == "summarize")
    return (
        tasks.withColumn("new_status", F.when(again, "pending").when(lost, "failed").otherwise(F.col("status")))
        .withColumn("progress", F.when(again | lost, 0).otherwise(F.col("progress")))
        .withColumn("dispatched_at", F.when(again, None).otherwise(F.col("dispatched_at")))
        .withColumn("logged", F.when(again, "requeued").when(lost, "failed"))
        .drop("status")
        .withColumnRenamed("new_status", "status")
    )


def retry(tasks: DataFrame, task_ids: list[str]) -> DataFrame:
    """Failed tasks asked for are pending again, undispatched, from 0."""
    asked = F.col("task_id").isin(*task_ids) & (F.col("status") == "failed")
    return (
        tasks.withColumn("dispatched_at", F.when(asked, None).otherwise(F.col("dispatched_at")))
        .withColumn("progress", F.when(asked, 0).otherwise(F.col("progress")))
        .withColumn("status", F.when(asked, "pending").otherwise(F.col("status")))
    )


def ingest_progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(60) + F.floor(F.lit(35) * done / F.greatest(total, F.lit(1))), F.lit(95)).cast("int")


def summarize_progress(done: Column, total: Column) -> Column:
    return (F.lit(5) + F.floor(F.lit(80) * done / F.greatest(total, F.lit(1)))).cast("int")


def _in_order(rows: DataFrame, key: str, order: list[str], fresh: Callable[[], Callable[..., object]], out: str) -> DataFrame:
    """(key, ``order``'s last column, ``out``) with what the key's own step says of each of its rows in order.

    ``fresh`` makes a step, which keeps the state of one key; rows stream through the task that
    has their key, so a key with a third of all rows is long but takes no memory.
    """
    kinds = dict(rows.dtypes)
    name = out.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = object(), None
        for batch in batches:
            keys, *columns = (batch.column(c).to_pylist() for c in (key, *order))
            said = []
            for k, *values in zip(keys, *columns):
                if k != held:
                    held, step = k, fresh()
                said.append(step(*values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(order[-1]), pa.array(said, pa.bool_())], names=[key, order[-1], name]
            )

    sorted_rows = rows.select(key, *order).repartition(key)
    sorted_rows = sorted_rows.sortWithinPartitions(key, *(F.asc_nulls_last(c) for c in order))
    return sorted_rows.mapInArrow(run, f"{key} {kinds[key]}, {order[-1]} {kinds[order[-1]]}, {out}")


def rate_limit(requests: DataFrame, capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """(client, event_id, allowed) by a token bucket for each client that starts full.

    ``requests``: client, event_id, ts (seconds as double). Each request first refills the
    bucket by the time since the last one; with at least one token it is allowed and takes it,
    else it is denied and takes none. A request without a time comes last and refills nothing.
    """

    def fresh() -> Callable[..., bool]:
        level, last = float(capacity), None

        def step(ts: float | None, _: object) -> bool:
            nonlocal level, last
            if ts is not None and last is not None:
                level = min(float(capacity), level + (ts - last) * float(refill))
            last = ts
            allowed = level >= 1.0
            level -= allowed
            return allowed

        return step

    return _in_order(requests, "client", ["ts", "event_id"], fresh, "allowed boolean")


def active_sessions(sessions: DataFrame, now: Column, hours: int = SESSION_HOURS) -> DataFrame:
    """Sessions younger than their fixed time to live; use does not renew them."""
    return sessions.where(F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS") > now)


def throttle(ticks: DataFrame, seconds: float = 3.0) -> DataFrame:
    """(task_id, seq) of progress ticks (task_id, ts, seq) at least ``seconds`` after the last one that was let through.

    Ticks without a time come last and are held back; of a task without any times the first goes through.
    """

    def fresh() -> Callable[..., bool]:
        last, any_yet = None, False

        def step(ts: float | None, _: object) -> bool:
            nonlocal last, any_yet
            through = not any_yet or (ts is not None and last is not None and ts - last >= seconds)
            if through:
                last, any_yet = ts, True
            return through

        return step

    return _in_order(ticks, "task_id", ["ts", "seq"], fresh, "through boolean").where("through").select("task_id", "seq")
