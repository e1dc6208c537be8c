"""Map-reduce summaries: segments into chapters, chapters into books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.operators.chunking import segments
from foliant.operators.providers import LanguageModel, complete_column, complete_stored

UNNAMED = "(untitled chapter)"
#: Prompt parts by language bucket.
PROMPTS = {
    "en": ("Summarize the chapter", "Summarize part", "Merge the summaries of the parts of", "Summarize the book from its chapters"),
    "zh": ("请概括本章", "请概括本章的一部分", "请合并各部分的概括", "请根据各章概括全书"),
}


def usable(chapters: DataFrame) -> DataFrame:
    return chapters.where(strip(F.coalesce("content", F.lit(""))) != "")


def to_summarize(chapters: DataFrame, restart: bool) -> DataFrame:
    """Usable chapters; when a run continues, only those whose summary is blank."""
    rows = usable(chapters)
    return rows if restart else rows.where(strip(F.coalesce("summary", F.lit(""))) == "")


def _completed(prompts: DataFrame, model: LanguageModel, into: str, calls: str | None) -> DataFrame:
    return complete_stored(prompts, "prompt", model, into, calls) if calls else complete_column(prompts, "prompt", model, into)


def chapter_summaries(
    chapters: DataFrame, model: LanguageModel, language: str = "zh", restart: bool = True, calls: str | None = None
) -> DataFrame:
    """(book_id, chapter_id, sort_order, title, summary) of all usable chapters.

    A chapter of one segment is one call. Others are a call a segment and one that merges the
    segments' summaries in order. Kept summaries of a continued run are passed through. With
    ``calls``, a folder, all calls are made at once and kept there, and none is made twice.
    """
    whole, part, merge, _ = PROMPTS[language]
    todo = to_summarize(chapters, restart)
    title = F.when(F.coalesce("title", F.lit("")) == "", UNNAMED).otherwise(F.col("title"))
    named = todo.select("book_id", "chapter_id", "sort_order", title.alias("title"))
    cut = segments(todo.select("book_id", "chapter_id", "content"))
    total = cut.groupBy("chapter_id").agg(F.count("*").alias("total"))
    rows = cut.join(total, "chapter_id").join(named.drop("book_id"), "chapter_id")
    label = F.concat_ws("/", F.col("segment_no") + 1, "total")
    prompt = F.when(F.col("total") == 1, F.concat(F.lit(f"{whole}: "), "title", F.lit("\n\n"), "segment")).otherwise(
        F.concat(F.lit(f"{part} "), label, F.lit(": "), "title", F.lit("\n\n"), "segment")
    )
    mapped = _completed(rows.withColumn("prompt", prompt), model, "summary", calls and f"{calls}/parts")
    parts = mapped.groupBy("book_id", "chapter_id", "sort_order", "title", "total").agg(
        F.array_sort(F.collect_list(F.struct("segment_no", "summary"))).alias("parts")
    )
    joined = F.array_join(
        F.transform("parts", lambda p: F.concat(F.lit("["), p["segment_no"] + 1, F.lit("/"), F.col("total"), F.lit("] "), p["summary"])),
        "\n\n",
    )
    reduce = F.when(F.col("total") > 1, F.concat(F.lit(f"{merge} "), "title", F.lit("\n\n"), joined)).otherwise("")
    reduced = _completed(parts.withColumn("prompt", reduce), model, "merged", calls and f"{calls}/merged")
    summary = F.when(F.col("total") > 1, F.col("merged")).otherwise(F.col("parts")[0]["summary"])
    new = reduced.select("book_id", "chapter_id", "sort_order", "title", summary.alias("summary"))
    if restart:
        return new
    old = usable(chapters).where(strip(F.coalesce("summary", F.lit(""))) != "")
    return new.unionByName(old.select("book_id", "chapter_id", "sort_order", title.alias("title"), "summary"))


def book_prompts(summaries: DataFrame, language: str = "zh") -> DataFrame:
    """(book_id, prompt): the chapters' summaries of each book, numbered in chapter order."""
    rows = summaries.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.struct("sort_order", "chapter_id", "title", "summary"))).alias("all")
    )
    body = F.transform("all", lambda c, i: F.concat(F.lit("["), i + 1, F.lit("] "), c["title"], F.lit("\n"), c["summary"]))
    return rows.select("book_id", F.concat(F.lit(f"{PROMPTS[language][3]}:\n\n"), F.array_join(body, "\n\n")).alias("prompt"))


def book_summaries(summaries: DataFrame, model: LanguageModel, language: str = "zh", calls: str | None = None) -> DataFrame:
    return _completed(book_prompts(summaries, language), model, "summary", calls and f"{calls}/books").select("book_id", "summary")


def pseudo_chunks(summaries: DataFrame, books: DataFrame) -> DataFrame:
    """Summaries as chunks of the vector table only, under ids that stay the same from run to run."""
    parts = summaries.select(
        F.concat("chapter_id", F.lit(":summary")).alias("id"), "book_id", "chapter_id", strip(F.col("summary")).alias("content")
    )
    whole = books.select(
        F.concat("book_id", F.lit(":summary")).alias("id"), "book_id", F.lit("").alias("chapter_id"), strip(F.col("summary")).alias("content")
    )
    both = parts.unionByName(whole).where("content != ''")
    return both.withColumn("position", F.lit(-1)).withColumn("token_count", F.lit(0))
