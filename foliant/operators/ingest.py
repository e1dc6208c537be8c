"""Ingestion as one operator: parsed book files into books, chapters, chunks and vectors, then summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import book_language, clean_whitespace
from foliant.operators import catalog, chunking, providers, summarize

TABLES = ("books", "chapters", "chunks", "vectors")


@dataclass(frozen=True)
class Source:
    """What a run of ingestion starts from: parsed files, and how they are cut and embedded."""

    parsed: DataFrame
    embedder: providers.Embedder | None = None
    size: int = 500
    overlap: int = 50


@dataclass(frozen=True)
class Ingested:
    """All tables of ingestion; as plans nothing has run yet, as ``stored`` they are read from their files."""

    books: DataFrame
    chapters: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    source: Source | None = None


def book_key(path: Column) -> Column:
    """A book's id: the same for the same path in every run, so that a second run replaces the first."""
    return F.substring(F.sha2(path, 256), 1, 32)


def _books(parsed: DataFrame) -> DataFrame:
    """One row a book, from its first chapter; a book that could not be read is ``failed`` and has the reason.

    The title's characters decide the language where they tell one, whatever the file declares.
    """
    first = (("book_title", "title"), ("author", "author"), ("language", "declared"), ("cover", "cover"), ("error", "error_msg"))
    rows = parsed if "error" in parsed.columns else parsed.withColumn("error", F.lit(None).cast("string"))
    rows = rows if "cover" in rows.columns else rows.withColumn("cover", F.lit(None).cast("binary"))
    books = rows.groupBy(book_key(F.col("path")).alias("book_id")).agg(
        F.min("path").alias("path"),
        *(F.min_by(c, "sort_order").alias(n) for c, n in first),
        F.count(F.when(F.col("error").isNull(), 1)).alias("n_chapters"),
    )
    language = F.when(F.col("error_msg").isNull(), book_language(F.col("declared"), F.col("title")))
    status = F.when(F.col("error_msg").isNull(), "ready").otherwise("failed")
    return books.select(
        "book_id", "path", "title", "author", language.alias("language"), "cover", status.alias("status"),
        F.coalesce("error_msg", F.lit("")).alias("error_msg"), "n_chapters",
    )


def _chapters(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("error is null") if "error" in parsed.columns else parsed
    return rows.select(
        book_key(F.col("path")).alias("book_id"),
        F.concat_ws("#", book_key(F.col("path")), "sort_order").alias("chapter_id"),
        "title",
        "level",
        "sort_order",
        clean_whitespace(F.coalesce(F.col("content"), F.lit(""))).alias("content"),
    ).where("content != ''")


def _vectors(chunks: DataFrame, embedder: providers.Embedder | None) -> DataFrame:
    return providers.embed_chunks(chunks, embedder).select(
        F.col("chunk_id").alias("id"), "book_id", "chapter_id", "content", "position", "token_count", "vector"
    )


def ingest(
    parsed: DataFrame, embedder: providers.Embedder | None = None, size: int = 500, overlap: int = 50
) -> Ingested:
    """Clean, chunk and embed ``parsed``, the rows of ``sources.books.read_books``, as one plan.

    A chapter whose cleaned content is empty is left out. Book columns come from the first
    chapter. Only narrow rows are grouped by book; contents stay spread by chapter.
    """
    chapters = _chapters(parsed)
    chunks = chunking.chunks(chapters, size, overlap)
    source = Source(parsed, embedder, size, overlap)
    return Ingested(_books(parsed), chapters, chunks, _vectors(chunks, embedder), source)


def store(done: Ingested, folder: str) -> Ingested:
    """Run an ingestion into tables under ``folder``, by book, and return them as they are read again.

    Each step reads what the one before has written: files are parsed twice, for books and for
    chapters, chunks are cut from the stored chapters and embedded from the stored chunks. All
    books of this run, failed and empty ones too, lose their older parts. Other books stay. A
    chunk whose text the store has a vector for is not embedded again.
    """
    source, spark = done.source, done.books.sparkSession
    run = f"{folder}/run"
    _books(source.parsed).write.mode("overwrite").parquet(f"{run}/books")
    books = spark.read.parquet(f"{run}/books")
    ids = [r["book_id"] for r in books.select("book_id").collect()]  # the books of one run

    def replaced(rows: DataFrame, name: str) -> DataFrame:
        """The run's rows, written on the way from one step to the next, and then into the table."""
        rows.write.mode("overwrite").parquet(f"{run}/{name}")
        out = spark.read.schema(rows.schema).parquet(f"{run}/{name}")
        catalog.replace_parts(out, f"{folder}/{name}", ids)
        return out

    catalog.replace_parts(books, f"{folder}/books", ids)
    chapters = replaced(_chapters(source.parsed), "chapters")
    chunks = replaced(chunking.chunks(chapters, source.size, source.overlap), "chunks")
    replaced(_embedded(spark, chunks, folder, source.embedder), "vectors")
    return stored(spark, folder)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _embedded(spark: SparkSession, chunks: DataFrame, folder: str, embedder: providers.Embedder | None) -> DataFrame:
    """Vectors of the chunks, by the digest of their text: only digests without a vector are embedded, each once.

    ``digests`` under the folder keeps (digest, vector) of every text so far; what no chunk has
    any more goes with ``drop_orphans``.
    """
    path = f"{folder}/digests"
    named = chunks.withColumn("digest", digest(F.col("content")))
    new = named.select("digest", "content").dropDuplicates(["digest"])
    known = _known(spark, path)
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")
    providers.embed_chunks(new, embedder).select("digest", "vector").write.mode("append").parquet(path)
    vectors = spark.read.parquet(path).dropDuplicates(["digest"])  # a run that was cut short may have written some twice
    columns = [F.col("chunk_id").alias("id"), "book_id", "chapter_id", "content", "position", "token_count", "vector"]
    return named.join(vectors, "digest").select(*columns)


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def drop_orphans(spark: SparkSession, folder: str) -> int:
    """Rewrite ``digests`` without those that no stored chunk has; returns how many went."""
    path, aside = f"{folder}/digests", f"{folder}/run/digests"
    held = spark.read.parquet(f"{folder}/chunks").select(digest(F.col("content")).alias("digest")).distinct()
    before = spark.read.parquet(path)
    before.join(held, "digest", "left_semi").write.mode("overwrite").parquet(aside)
    gone = before.count() - spark.read.parquet(aside).count()
    spark.read.parquet(aside).write.mode("overwrite").parquet(path)
    return gone


def stored(spark: SparkSession, folder: str) -> Ingested:
    return Ingested(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES))


def add_summaries(
    done: Ingested,
    model: providers.LanguageModel,
    folder: str,
    language: str = "zh",
    embedder: providers.Embedder | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What follows ingestion: (summaries by chapter, vectors with the summaries' pseudo chunks).

    Model calls are kept under ``folder`` as they are made, so that a run that dies or is made
    again asks nothing twice; summaries are written there and read again. Pseudo chunks of an earlier run of these chapters and books are replaced.
    """
    spark = done.books.sparkSession
    summarize.chapter_summaries(done.chapters, model, language, calls=f"{folder}/calls").write.mode("overwrite").parquet(f"{folder}/chapter_summaries")
    chapters = spark.read.parquet(f"{folder}/chapter_summaries")
    summarize.book_summaries(chapters, model, language, f"{folder}/calls").write.mode("overwrite").parquet(f"{folder}/book_summaries")
    books = spark.read.parquet(f"{folder}/book_summaries")
    new = providers.embed_chunks(summarize.pseudo_chunks(chapters, books), embedder).select(*done.vectors.columns)
    ids = done.chapters.select(F.col("chapter_id").alias("id")).union(done.books.select("book_id"))
    kept = done.vectors.join(ids.select(F.concat("id", F.lit(":summary")).alias("id")), "id", "left_anti")
    return chapters, kept.unionByName(new)
