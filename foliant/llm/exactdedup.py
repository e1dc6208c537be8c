"""Exact deduplication as a stateful stream, with DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, scratch_path, settings, stash, with_field

#: Settings of the stream's state: on disk, without expiry.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no preallocated files, and changes rather than whole stores to the checkpoint
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Settings of the byte check. A Bloom filter of the digests with copies keeps other texts out of
#: the shuffle; the join's groups are combined and dealt again, so a hot one can be split.
BYTES = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def dedup_state(digests: DataFrame) -> DataFrame:
    """What the keyed state retains for each digest of a stream of (digest, doc_id, locator).

    keep_id: the least identifier; keep_locator: where its row is; group_size: rows seen.
    Identifiers may be of any ordered type; a null one counts only where there is no other. The
    state never expires, so a stream may meet a copy at any later time.
    """
    return digests.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("locator", "doc_id"), F.min("locator")).alias("keep_locator"),
        F.count("*").alias("group_size"),
    )


def run_stream(digests: DataFrame, per_trigger: int = 64 << 30) -> DataFrame:
    """Feed a stashed table of (digest, doc_id, locator) through the stateful stream.

    Each micro-batch writes the state of the digests that it touched; the result has the last
    state of each. The stream's checkpoint and these tables are in the shared folder.
    """
    spark = digests.sparkSession
    out = scratch_path(spark, "dedup-state")
    written = []
    with settings(spark, STATE):
        source = spark.readStream.schema(digests.schema).option("maxBytesPerTrigger", per_trigger)
        stream = dedup_state(source.parquet(digests._stash_path).select("digest", "doc_id", "locator"))

        def write(batch: DataFrame, number: int) -> None:
            # the number names the folder: a batch that is run again replaces what it wrote
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            written.append(number)

        query = (
            stream.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", scratch_path(spark, "dedup-stream"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    schema = stream.schema
    if not written:
        return spark.createDataFrame([], schema)
    states = spark.read.schema(with_field(schema, "batch", "long")).option("basePath", out).parquet(out)
    newest = F.max_by(F.struct(*(c for c in schema.fieldNames() if c != "digest")), "batch").alias("s")
    return states.groupBy("digest").agg(newest).select("digest", "s.*")


#: Digests of a normalised text, each tried when the one before it is shared by two texts.
DIGESTS = (lambda norm: F.unhex(F.sha2(norm.cast("binary"), 256)), lambda norm: F.unhex(F.sha2(norm.cast("binary"), 512)))


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_row: bool = False, digests: tuple = DIGESTS
) -> DataFrame:
    """Group rows whose texts are equal after white-space runs become one space each.

    Returns per row: doc_id, keep_id (the smallest doc_id of its group), group_size, kept (true
    for one row of each group, which has keep_id), text_sha256 (of the normalised text) and,
    with ``keep_row``, the input row as struct ``record``.

    Rows whose digest the state had before (hits) are compared by their full bytes: they are
    grouped again by digest and whole text, which combines copies before any shuffle. If two
    texts share a digest, the stream runs again with the next digest. Only the state of texts
    with copies meets the rows again; a row that finds none stands alone.
    Null text counts as empty; doc_id is of any ordered type, a null one sorts after all others;
    rows that repeat a doc_id are rows of their own, of which any one is kept; other columns may
    have any name.
    """
    rows, content = pick(docs, doc_id=doc_id, text=text), F.col("text")
    if keep_row:
        record = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("record")
        rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), record)
        content = F.col(f"record.`{text}`")
    norm = normalised(content)
    spark = docs.sparkSession
    for digest in digests:
        marked = rows.withColumn("digest", digest(norm)).withColumn("sha256", F.unhex(F.sha2(norm.cast("binary"), 256)))
        marked = stash(marked.withColumn("locator", F.monotonically_increasing_id()), "digests")
        # a row for each text that has copies; as a table, its size decides how the two joins are done
        state = stash(run_stream(marked).where("group_size > 1"), "state")
        # the condition holds for all these rows: it tells the optimiser that a filter is worth while
        hits = marked.select("digest", content.alias("text")).join(
            state.where("group_size > 1").select("digest"), "digest", "left_semi"
        )
        texts = hits.groupBy("digest", normalised(F.col("text")).alias("norm")).agg(F.count("*").alias("n"))
        shared = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
        with settings(spark, BYTES):
            if not shared.limit(1).count():
                break
        discard(marked, state)
    else:
        raise ValueError("different texts share every digest that was given")
    alone = F.col("group_size").isNull()
    if keep_row:  # whole rows are not sorted for the join; a task's share of the state is a row a text
        state = state.hint("shuffle_hash")
    return marked.join(state, "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("locator") == F.col("keep_locator"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        *(["record"] if keep_row else []),
    )
