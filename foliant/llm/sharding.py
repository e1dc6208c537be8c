"""Two-pass external shuffle into shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import stash
from foliant.llm.groups import by_bucket

BUCKET_BYTES = 32 << 20
#: Most tasks of the second pass.
TASKS = 1 << 15


def text_bytes(docs: DataFrame, text: str) -> Column:
    return (F.coalesce(F.octet_length(docs[f"`{text}`"]), F.lit(0)) + 64).cast("long")


def row_bytes(docs: DataFrame, text: str) -> Column:
    """``text_bytes`` and what the other columns hold: strings' and binaries' own bytes, nested ones as JSON text."""
    size = text_bytes(docs, text)
    for name, kind in docs.dtypes:
        c = docs[f"`{name}`"]
        if kind in ("string", "binary") and name != text:
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int) -> int:
    """Buckets of about ``bucket_bytes`` of text, doubled while whole rows would fill them more than twice.

    So a small column more or less leaves the order as it is, and wide ones don't make buckets large.
    """
    own, whole = docs.agg(F.sum(text_bytes(docs, text)), F.sum(row_bytes(docs, text))).first()
    buckets = max(1, -(-(own or 0) // bucket_bytes))
    while (whole or 0) > 2 * bucket_bytes * buckets:
        buckets *= 2
    return int(buckets)


def shuffled(docs: DataFrame, text: str, seed: int, bucket_bytes: int, tasks: int = TASKS) -> DataFrame:
    """(bucket, pos, record): every row in a random place of a random bucket, written as a table.

    First pass: a seeded hash of the row's place in the input scatters rows uniformly over
    buckets of about ``bucket_bytes``, so equal rows and equal ids spread out too. Second pass:
    a task takes one bucket after another, each in Fisher-Yates order, and writes them; Spark
    sorts a task's rows by bucket, on disk if need be, so Python holds one bucket at a time.
    There are as many tasks as buckets, at most ``tasks``.
    """
    record = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    buckets = bucket_count(docs, text, bucket_bytes)
    rows = docs.select(record.alias("record"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("draw"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(buckets)))

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, least=1):
            bucket = table.column("bucket")[0].as_py()
            order = np.argsort(table.column("draw").to_numpy())  # the order of arrival may differ when a task runs again
            order = order[np.random.default_rng((seed, bucket)).permutation(len(order))]
            for at in range(0, len(order), 1024):
                some = table.column("record").take(pa.array(order[at : at + 1024])).combine_chunks()
                pos = pa.array(np.arange(at, at + len(some)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), bucket)), pos, some], names=["bucket", "pos", "record"])

    schema = rows.select("bucket", F.lit(0).cast("long").alias("pos"), "record").schema
    number = F.pmod(F.col("bucket"), F.lit(min(buckets, tasks))).cast("int")
    dealt = rows.repartitionById(min(buckets, tasks), number).sortWithinPartitions("bucket")
    return stash(dealt.select("bucket", "draw", "record").mapInArrow(fisher_yates, schema), "buckets")


def shard(
    docs: DataFrame, text: str = "text", shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Put all rows into ``shards`` shards in random order, with row counts at most one apart.

    Returns (record, shard, slot): the input row as a struct, its shard and its place there,
    gapless from 0. The buckets in turn form one random order of all rows, which is dealt out
    in turn. Any column may be null, texts empty, rows repeated; columns may have any name; an
    empty table gives an empty result.
    """
    rows = shuffled(docs, text, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / 1024))
    sums = counts.groupBy("block").agg(F.sum("n").alias("s"))  # a row for 1024 buckets
    above = F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(
        sums.select("block", above.alias("above")), "block"
    )
    # a row a bucket; as a table its size is known, and while it is small the rows need no exchange
    base = stash(base.select("bucket", (F.col("above") + F.col("within")).alias("base")), "places")
    place = rows.join(base, "bucket")
    place = place.withColumn("place", F.col("base") + F.col("pos"))
    return place.select(
        "record", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").select(
        "record.*", "shard"
    ).write.partitionBy("shard").mode("overwrite").parquet(path)


def placement(sharded: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns of ``shard``, by the law `rows`."""
    content = F.coalesce(F.col(f"record.`{text}`"), F.lit(""))
    return sharded.select(
        F.col(f"record.`{doc_id}`").alias("doc_id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
