"""Streams with timers, batch by batch."""

from datetime import datetime, timedelta

from foliant.streaming import control as streams
from foliant.streaming import timers

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def stream_of(spark, path, schema, *batches):
    """Files that the stream reads one a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/in")


def collect(stream, path):
    with timers.rocksdb(stream.sparkSession):
        return sorted(map(tuple, streams.run_available(stream, f"file://{path}/state", f"file://{path}/out").collect()))


def test_sessions_end_by_themselves(spark, tmp_path):
    schema = "client string, ts timestamp"
    batches = [
        [("a", at(0)), ("a", at(5)), ("b", at(1)), ("late", at(2))],
        [("a", at(23)), ("late", at(1.5)), ("z", at(30))],  # z moves the watermark past the ends of a, b and late
        [("a", at(31)), ("z", at(40))],
    ]
    got = collect(timers.sessions(stream_of(spark, tmp_path, schema, *batches), 24, "1 hour"), tmp_path)
    assert got == [("a", at(0), 3), ("b", at(1), 1), ("late", at(2), 2)]  # z and the second session of a are still open


def test_the_next_event_ends_a_session_at_once(spark, tmp_path):
    schema = "client string, ts timestamp"
    got = collect(timers.sessions(stream_of(spark, tmp_path, schema, [("a", at(h)) for h in (0, 10, 24, 47.9, 48, 100)]), 24, "1000 hours"), tmp_path)
    assert got == [("a", at(0), 2), ("a", at(24), 2), ("a", at(48), 1)]


def test_tasks_without_a_heartbeat_are_lost_once(spark, tmp_path):
    schema = "task_id string, seq long, type string, status string, ts timestamp"
    batches = [
        [("i", 1, "ingest", "processing", at(0)), ("s", 1, "summarize", "processing", at(0)), ("done", 1, "ingest", "processing", at(0))],
        [("s", 2, "summarize", "processing", at(1)), ("done", 2, "ingest", "completed", at(0.5)), ("k", 1, "ingest", "pending", at(1))],
        [("k", 2, "ingest", "processing", at(3)), ("tick", 1, "ingest", "completed", at(9))],
        [("i", 2, "ingest", "processing", at(9.5)), ("tick", 2, "ingest", "completed", at(20))],
    ]
    stream = stream_of(spark, tmp_path, schema, *batches)
    got = collect(timers.lost_tasks(stream, 120.0, "30 minutes"), tmp_path)
    want = [("i", at(0), "requeued"), ("i", at(9.5), "requeued"), ("k", at(3), "requeued"), ("s", at(1), "failed")]
    assert got == want
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    from pyspark.sql import functions as F

    assert sorted(map(tuple, timers.lost_tasks_batch(table, F.lit(at(19.5)), 120.0).collect())) == want
