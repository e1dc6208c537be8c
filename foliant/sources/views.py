"""The domain's tables derived from the synthetic ones: books, chunks, vectors, tasks, sessions, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import document_chunks

#: Seconds since 1970 of 2024-01-01, when the first book came in.
FIRST = 1_704_067_200
LANGUAGES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book a document; its label decides its status."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("book_id"),
        F.lit("u1").alias("user_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("title"),
        F.col("source").alias("author"),
        F.try_element_at(names, "lang").alias("language"),
        F.col("source").alias("category"),
        F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("pending").alias("status"),
        F.when(F.col("quality") == 1, F.substring("text", 1, 60)).otherwise("").alias("summary"),
        (F.lit(FIRST) + F.col("doc_id")).alias("created_at"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book_id"), F.col("text").alias("content"))
    return document_chunks(docs)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as retrieval records."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("book_id"),
        F.col("doc_id").cast("string").alias("chapter_id"),
        F.col("text").alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("src"), F.col("vec_id") % 20).alias("book_id"), F.col("embedding").alias("vector")
    )


def micros(ts: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task an event."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "view", "processing")
        .otherwise("pending")
    )
    return e.select(
        F.col("event_id").cast("string").alias("task_id"),
        F.col("user_id").cast("string").alias("book_id"),
        F.when(F.col("event_id") % 5 == 0, "summarize").otherwise("ingest").alias("type"),
        status.alias("status"),
        (F.col("event_id") % 100).cast("int").alias("progress"),
        F.when(F.col("event_type").isin("signup"), None).otherwise(micros("ts")).alias("dispatched_at"),
        micros("ts").alias("created_at"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the stage log of a task a user."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    )
    return e.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.col("event_type").alias("stage"),
        F.concat(F.lit("event "), "event_id").alias("message"),
        (F.col("event_id") % 100).cast("int").alias("progress"),
        micros("ts").alias("at"),
    )


def heartbeats(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as signs of life of a task a user."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    return events.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 3 == 0, "summarize").otherwise("ingest").alias("type"),
        status.alias("status"),
        F.timestamp_micros(micros("ts")).alias("ts"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("client"), "event_id", (micros("ts") / 1e6).alias("ts"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session a conversation, ten users."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("updated_at")).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"),
        (F.lit(FIRST) + F.col("conv_id") * 7 % 1000).alias("updated_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("entry_id"),
        F.col("user_id").cast("string").alias("actor"),
        F.col("event_type").alias("action"),
        F.col("props").alias("detail"),
        micros("ts").alias("created_at"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters, ten a book."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("b"), F.floor(F.col("doc_id") / 10)).alias("book_id"),
        F.col("doc_id").cast("string").alias("chapter_id"),
        (F.col("doc_id") % 7).cast("int").alias("sort_order"),
        F.concat(F.lit("t"), "doc_id").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 60)).otherwise("").alias("summary"),
        F.col("text").alias("content"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user a customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user").alias("role"),
        F.when(F.col("c_custkey") % 3 == 0, "disabled").otherwise("active").alias("status"),
        (F.lit(FIRST) + F.col("c_custkey") * 13 % 997).alias("created_at"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access token an event; ends are times, empty or no time at all."""
    e = table(spark, sf_dir, "events")
    day = F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")
    end = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "never").otherwise(
        F.concat(F.lit("2024-01-"), day, F.lit(" 12:00:00"))
    )
    return e.select(
        F.col("event_id").cast("string").alias("token_id"),
        F.col("user_id").cast("string").alias("user_id"),
        micros("ts").alias("created_at"),
        end.alias("expires_at"),
        (F.col("event_type") == "error").alias("is_revoked"),
    )


#: Letters and the Han characters that stand for them in ``unspaced``.
LETTERS, HAN_LETTERS = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + k) for k in range(26))


def unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose letters are Han characters and whose spaces are gone: text that must be cut into words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.translate(F.lower("text"), LETTERS + " ", HAN_LETTERS).alias("text"))
