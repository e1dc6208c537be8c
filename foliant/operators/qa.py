"""Answers with citations: tool decision, retrieval, prompt, stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.catalog import book_info, count_map
from foliant.operators.providers import LanguageModel, Tools, tool_arguments

TOP_K = 5
QUOTED = 200
#: Fixed value: the context of a question without hits.
NO_CONTEXT = "（无相关片段）"


def context(hits: DataFrame) -> DataFrame:
    """One row: the numbered contents of the hits (score, id, content), best first."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # at most k rows
    numbered = hits.select(place.alias("place"), "content")
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "content"))),
        lambda h: F.concat(F.lit("["), h["place"].cast("string"), F.lit("] "), h["content"]),
    )
    return numbered.agg(
        F.when(F.count("*") == 0, NO_CONTEXT).otherwise(F.array_join(lines, "\n\n")).alias("context"), F.count("*").alias("n")
    )


def citations(hits: DataFrame) -> DataFrame:
    return hits.select("id", "chapter_id", "book_id", "score", F.substring("content", 1, QUOTED).alias("content"))


def cited_titles(cited: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Citations with titles where known, else ids, and their scores in percent."""
    names = books.select("book_id", F.col("title").alias("book_title"))
    parts = chapters.select("chapter_id", F.col("title").alias("chapter_title"))
    rows = cited.join(names, "book_id", "left").join(parts, "chapter_id", "left")
    return rows.select(
        "id",
        F.coalesce("book_title", "book_id").alias("book_title"),
        F.coalesce("chapter_title", "chapter_id").alias("chapter_title"),
        F.round(F.col("score") * 100).cast("int").alias("percent"),
    )


def library_tools(books: DataFrame, chapters: DataFrame) -> Tools:
    def get_library_stats() -> dict:
        row = count_map(books).first()
        return {"total": row["total"], "by_status": row["by_status"]}

    def get_book_info(query: str) -> dict:
        rows = book_info(books, chapters, query).collect()  # five books at most
        if not rows:
            return {"error": f"no book matches: {query}"}
        return {"books": [r.asDict(recursive=True) for r in rows]}

    return Tools({"get_library_stats": get_library_stats, "get_book_info": get_book_info})


def answer(
    messages: Sequence[dict], retrieve: Callable[[str], DataFrame], model: LanguageModel, tools: Tools | None = None
) -> Iterator[dict]:
    """Events of one answer: deltas, then exactly one list of citations.

    Only the first tool call counts; whatever fails in the decision leaves plain retrieval. An
    error of the model in the middle of the stream ends it quietly. The hits are few (top k).
    """
    call = None
    if tools:
        try:
            calls = model.decide(messages, list(tools.tools)).get("tool_calls") or []
            call = calls[0] if calls else None
        except Exception:
            call = None
    cited: list[dict] = []
    if call is not None:
        system = json.dumps(tools.run(call["name"], tool_arguments(call)), ensure_ascii=False, default=str)
    else:
        hits = retrieve(messages[-1]["content"] if messages else "")
        rows = hits.orderBy(F.desc("score"), "id").collect()
        system = "\n\n".join(f"[{i}] {r['content']}" for i, r in enumerate(rows, 1)) or NO_CONTEXT
        cited = [{k: r[k] for k in ("id", "chapter_id", "book_id", "score")} | {"content": r["content"][:QUOTED]} for r in rows]
    try:
        for delta in model.stream([{"role": "system", "content": system}, *messages]):
            yield {"type": "delta", "content": delta}
    except Exception:
        return
    yield {"type": "citations", "citations": cited}
