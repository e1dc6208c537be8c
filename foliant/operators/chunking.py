"""Books into chapters, segments and overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.functions.text import clean_title, is_back_matter, is_heading, strip

#: Characters that end a sentence.
SENTENCE_ENDS = "。！？.!?"
#: What ends a line besides the line feed.
LINE_ENDS = r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def windows(content: Column, size: int, overlap: int) -> Column:
    """The stripped windows of ``size`` characters, each ``overlap`` into the next, without blank ones.

    The text is cut into steps once, by one pattern, and a window is the end of some neighbours
    put together, so the work is linear in the text however long it is.
    """
    size, overlap = max(size, 1), max(overlap, 0)
    step = max(size - overlap, 1)
    beyond = -(-size // step)  # steps that a window reaches into

    def cut(parts: Column) -> Column:
        whole = F.transform(parts, lambda _, i: F.substring(F.array_join(F.slice(parts, i + 1, F.lit(beyond)), ""), 1, size))
        return F.filter(F.transform(whole, strip), lambda p: p != "")

    steps = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.transform(F.array(steps), cut)[0]  # an array of one value binds it to a name, so that it is cut once


def chunks(chapters: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Overlapping windows over each chapter's content, positions counted through the book.

    ``chapters``: book_id, chapter_id, sort_order, content. Returns chunk_id, book_id,
    chapter_id, content, position, token_count. One narrow row a chapter is numbered within its
    book; chapters get their first position by a join, and are cut after it, so what may move is
    a chapter's content once, spread by chapter, never the overlapping chunks.
    """
    before = Window.partitionBy("book_id").orderBy("sort_order", "chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = chapters.select("book_id", "chapter_id", "sort_order", F.size(windows(F.col("content"), size, overlap)).alias("n"))
    first = counted.select("book_id", "chapter_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = chapters.select("book_id", "chapter_id", "content").join(first, ["book_id", "chapter_id"])
    return (
        placed.select("book_id", "chapter_id", "first", F.posexplode(windows(F.col("content"), size, overlap)).alias("at", "content"))
        .withColumn("position", (F.col("first") + F.col("at")).cast("int"))
        .select(
            F.concat_ws(":", "book_id", "position").alias("chunk_id"),
            "book_id",
            "chapter_id",
            "content",
            "position",
            F.length("content").alias("token_count"),
        )
    )


def document_chunks(documents: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of books of one chapter: no window, no join, no shuffle."""
    pieces = F.posexplode(windows(F.col("content"), size, overlap))
    return documents.select("book_id", pieces.alias("position", "content")).select(
        F.concat_ws(":", "book_id", "position").alias("chunk_id"),
        "book_id",
        F.col("book_id").alias("chapter_id"),
        "content",
        "position",
        F.length("content").alias("token_count"),
    )


def cuts(text: str, target: int = 10_000, hard: int = 12_000) -> list[str]:
    """Segments of one text: a paragraph end from ``target`` on, else the last sentence end up to
    ``hard``, else ``hard``. A text within ``hard`` stays whole."""
    if len(text) <= hard:
        return [text] if text else []
    out, at = [], 0
    while len(text) - at > hard:
        line = text.find("\n", at + target, at + hard)
        if line >= 0:
            end = line + 1
        else:
            window = text[at + target : at + hard]
            sentence = max(window.rfind(c) for c in SENTENCE_ENDS)
            end = at + target + sentence + 1 if sentence >= 0 else at + hard
        out.append(text[at:end].strip())
        at = end
    out.append(text[at:].strip())
    return [s for s in out if s]


def segments(chapters: DataFrame, target: int = 10_000, hard: int = 12_000) -> DataFrame:
    """(book_id, chapter_id, segment_no, segment) of each chapter's content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a text at a time, so that a task holds one text's segments
                parts = cuts(batch.column("content")[at].as_py(), target, hard)
                own = [batch.column(c).take(pa.array([at] * len(parts), pa.int64())) for c in ("book_id", "chapter_id")]
                columns = [*own, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["book_id", "chapter_id", "segment_no", "segment"])

    whole = F.coalesce("content", F.lit(""))
    short = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    # the common short chapter never leaves the JVM
    near = chapters.where(F.length(whole) <= hard).select("book_id", "chapter_id", short.alias("s"))
    far = chapters.where(F.length(whole) > hard).select("book_id", "chapter_id", "content")
    out = StructType([*far.schema.fields[:2], *StructType.fromDDL("segment_no int, segment string")])
    return near.select("book_id", "chapter_id", F.posexplode("s").alias("segment_no", "segment")).union(far.mapInArrow(cut, out))


def chapters_of_text(books: DataFrame, skip_back_matter: bool = True) -> DataFrame:
    """Chapters of plain-text books (book_id, title, content) by their heading lines.

    Lines before the first heading belong to a chapter with the book's title; chapters without
    content and, if asked, back matter are dropped; a book left without chapters is one chapter
    with its whole text. Returns book_id, chapter_id, title, level, sort_order, content. All
    lines of a book stay in its row: heading lines are found once, and each chapter is the slice
    between two of them, so the work is linear in the book.
    """
    lines = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), LINE_ENDS, "\n"), "\n")

    def chapters_between(row: F.Column, at: F.Column) -> F.Column:
        """Chapters of the lines ``row`` with headings ``at``; the lines before all headings come first."""

        def chapter(start: F.Column, number: F.Column) -> F.Column:
            end = F.coalesce(F.get(at, number), F.size(row))
            title = F.when(start < 0, F.col("title")).otherwise(strip(F.get(row, F.greatest(start, F.lit(0)))))
            body = F.array_join(F.slice(row, start + 2, end - start - 1), "\n")
            return F.struct(clean_title(title).alias("title"), strip(body).alias("content"))

        return F.transform(F.concat(F.array(F.lit(-1)), at), chapter)

    def headings(row: F.Column) -> F.Column:
        return F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda i: is_heading(F.get(row, i)))

    # an array of one value binds it to a name, so that it is computed once a book
    parts = F.transform(F.array(lines), lambda row: F.transform(F.array(headings(row)), lambda at: chapters_between(row, at))[0])[0]
    kept = F.filter(parts, lambda c: (c["content"] != "") & (~is_back_matter(c["title"]) if skip_back_matter else F.lit(True)))
    whole = F.array(F.struct(clean_title(F.col("title")).alias("title"), strip(F.col("content")).alias("content")))
    split = books.select("book_id", whole.alias("whole"), kept.alias("kept"))
    return split.select(
        "book_id", F.posexplode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("whole"))).alias("sort_order", "chapter")
    ).select(
        "book_id",
        F.concat_ws("#", "book_id", "sort_order").alias("chapter_id"),
        "chapter.title",
        F.lit(1).alias("level"),
        "sort_order",
        "chapter.content",
    )


def chapters_of_lines(lines: DataFrame, skip_back_matter: bool = True) -> DataFrame:
    """The same split for books too long for one row: ``lines`` has book_id, title, line_no, line.

    A running count of headings numbers the chapters; their lines are then gathered by chapter.
    """
    order = Window.partitionBy("book_id").orderBy("line_no")
    marked = lines.withColumn("heading", is_heading(F.col("line")))
    marked = marked.withColumn("part", F.sum(F.col("heading").cast("int")).over(order))
    parts = marked.groupBy("book_id", "part").agg(
        F.coalesce(F.max(F.when(F.col("heading"), strip(F.col("line")))), F.max("title")).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line")))).alias("body"),
    )
    text = strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n"))
    kept = parts.select("book_id", "part", clean_title(F.col("title")).alias("title"), text.alias("content"))
    kept = kept.where("content != ''")
    if skip_back_matter:
        kept = kept.where(~is_back_matter(F.col("title")))
    number = Window.partitionBy("book_id").orderBy("part")
    return kept.withColumn("sort_order", F.row_number().over(number) - 1).select(
        "book_id",
        F.concat_ws("#", "book_id", "sort_order").alias("chapter_id"),
        "title",
        F.lit(1).alias("level"),
        "sort_order",
        "content",
    )

