"""Structured Streaming twins of the control operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.control import CAPACITY, REFILL


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The events table as a stream of files; as a pattern the path may be one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/[e]vents.parquet")


def task_states(events: DataFrame) -> DataFrame:
    """The state machine as a running aggregate: each task's last status and its number of events."""
    last = F.max_by(F.struct("status", "progress", "stage"), "seq")
    done = events.groupBy("task_id").agg(last.alias("last"), F.count("*").alias("n_events"))
    progress = F.when(F.col("last.status") == "completed", 100).otherwise(F.col("last.progress"))
    return done.select("task_id", "last.status", progress.alias("progress"), "last.stage", "n_events")


def rate_limit(requests: DataFrame, capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """Token buckets whose level and last time are the state of each client."""

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        allowed = []
        for ts in rows["ts"]:
            level = min(float(capacity), level + (0.0 if last is None else ts - last) * refill)
            allowed.append(level >= 1.0)
            level -= 1.0 if level >= 1.0 else 0.0
            last = ts
        state.update((level, last))
        yield pd.DataFrame({"client": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return requests.groupBy("client").applyInPandasWithState(
        decide, "client string, event_id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout
    )


def sessions_alive(logins: DataFrame, hours: int = 24) -> DataFrame:
    """(client, opened_at, n) of sessions of a fixed time to live, which a first event opens.

    Later events within that time belong to the session and do not renew it; the next one after
    it opens a new session.
    """
    life = hours * 3600.0

    def open_close(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        out = []
        for ts in pd.concat(list(parts)).sort_values(["ts", "event_id"])["ts"]:
            if opened is None or ts >= opened + life:
                if opened is not None:
                    out.append((key[0], opened, n))
                opened, n = ts, 0
            n += 1
        state.update((opened, n))
        yield pd.DataFrame(out, columns=["client", "opened_at", "n"])

    return logins.groupBy("client").applyInPandasWithState(
        open_close, "client string, opened_at double, n long", "opened double, n long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "append", last_by: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Each batch replaces its own folder, so a batch that runs again changes nothing. With
    ``last_by`` only the latest row of each key counts.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    if not last_by:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in last_by]
    return rows.groupBy(*last_by).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*last_by, "row.*")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local master may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"


def run_query(stream: DataFrame, name: str, mode: str = "append", last_by: list[str] | None = None) -> DataFrame:
    spark = stream.sparkSession
    return run_available(stream, scratch(spark, f"{name}-state"), scratch(spark, name), mode, last_by)

