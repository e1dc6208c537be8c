"""The catalog: filtered and paged lists, counts, joins of books with their parts, and table changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, BOOK_PAGE_MOST, CHUNK_PAGE, CHUNK_PAGE_MOST, SESSIONS_KEPT = 20, 200, 50, 500, 100
ACTIVE = ("pending", "processing")


@dataclass(frozen=True)
class Page:
    """A page of an ordered list; numbers out of range become the defaults, not the nearest bound."""

    number: int = 1
    size: int = PAGE
    most: int = BOOK_PAGE_MOST
    usual: int = PAGE

    def of(self, rows: DataFrame, *order: Column | str) -> DataFrame:
        number = self.number if self.number >= 1 else 1
        size = self.size if 1 <= self.size <= self.most else self.usual
        return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def filter_books(books: DataFrame, status: str | None = None, q: str | None = None) -> DataFrame:
    """Books by status and by a pattern in title or author, whatever the case; % and _ are wildcards."""
    if status:
        books = books.where(F.col("status") == status)
    if q:
        books = books.where(F.col("title").ilike(f"%{q}%") | F.col("author").ilike(f"%{q}%"))
    return books


def list_books(books: DataFrame, status: str | None = None, q: str | None = None, page: Page = Page()) -> DataFrame:
    """Newest first, ties by id; one scan, filters pushed to it, a top-k heap and no full sort."""
    return page.of(filter_books(books, status, q), F.desc("created_at"), "book_id")


def list_chunks(chunks: DataFrame, book_id: str, chapter_id: str | None = None, number: int = 1, size: int = 0) -> DataFrame:
    rows = chunks.where(F.col("book_id") == book_id)
    if chapter_id:
        rows = rows.where(F.col("chapter_id") == chapter_id)
    return Page(number, size, CHUNK_PAGE_MOST, CHUNK_PAGE).of(rows, "position", "chunk_id")


def list_chapters(chapters: DataFrame, book_id: str) -> DataFrame:
    return chapters.where(F.col("book_id") == book_id).orderBy("sort_order", "chapter_id")


def list_tasks(tasks: DataFrame, status: str | None = None, book_id: str | None = None, page: Page = Page()) -> DataFrame:
    if status:
        tasks = tasks.where(F.col("status") == status)
    if book_id:
        tasks = tasks.where(F.col("book_id") == book_id)
    return page.of(tasks, F.desc("created_at"), "task_id")


def list_audit(audit: DataFrame, page: Page = Page()) -> DataFrame:
    return page.of(audit, F.desc("created_at"), "entry_id")


def list_sessions(sessions: DataFrame, user_id: str) -> DataFrame:
    return sessions.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "session_id")


def list_messages(messages: DataFrame, session_id: str) -> DataFrame:
    """Oldest first; the sequence number settles equal seconds."""
    return messages.where(F.col("session_id") == session_id).orderBy("seq")


def list_tokens(tokens: DataFrame, user_id: str) -> DataFrame:
    """A user's access tokens, newest first, ties by id."""
    return tokens.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "token_id")


def list_users(users: DataFrame, page: Page = Page()) -> DataFrame:
    """Oldest first, ties by id."""
    return page.of(users, "created_at", "user_id")


def has_cover(books: DataFrame, book_id: str) -> DataFrame:
    """One row: whether the book is there and has a cover."""
    named = F.trim(F.coalesce("cover_path", F.lit(""))) != ""
    return books.agg(F.coalesce(F.bool_or((F.col("book_id") == book_id) & named), F.lit(False)).alias("has_cover"))


def oldest_queued(tasks: DataFrame, n: int = 1) -> DataFrame:
    queued = (F.col("type") == "ingest") & (F.col("status") == "pending") & F.col("dispatched_at").isNull()
    return tasks.where(queued).orderBy("created_at", "task_id").limit(n)


def orphans(tasks: DataFrame, kind: str) -> DataFrame:
    return tasks.where((F.col("type") == kind) & F.col("status").isin(*ACTIVE))


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Not revoked and not past their end; an end that is empty or no timestamp never comes."""
    end = F.try_to_timestamp("expires_at")
    return tokens.where(~F.col("is_revoked") & (end.isNull() | (end > now)))


def count_by(rows: DataFrame, key: str = "status") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def count_map(rows: DataFrame, key: str = "status") -> DataFrame:
    """One row: the counts as a map, and their total. The map has a key for each status."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))
    return count_by(rows, key).agg(counts.alias("by_status"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def dashboard(books: DataFrame, chunks: DataFrame, sessions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(metric, key, n): table sizes and books and tasks by status, each counted in one aggregate."""
    sizes = [
        rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "n")
        for name, rows in (("books", books), ("chunks", chunks), ("sessions", sessions))
    ]
    parts = [
        count_by(rows).select(F.lit(name).alias("metric"), F.col("status").alias("key"), "n")
        for name, rows in (("books_by_status", books), ("tasks_by_status", tasks))
    ]
    out = sizes[0]
    for more in (*sizes[1:], *parts):
        out = out.unionByName(more)
    return out


def running_ingests(tasks: DataFrame) -> DataFrame:
    running = (F.col("type") == "ingest") & F.col("dispatched_at").isNotNull() & F.col("status").isin(*ACTIVE)
    return tasks.where(running).agg(F.count("*").alias("n"))


def book_info(books: DataFrame, chapters: DataFrame, q: str, most: int = 5) -> DataFrame:
    """The newest books that match, each with its chapters' titles and summaries in order."""
    found = list_books(books, q=q, page=Page(1, most))
    parts = chapters.join(F.broadcast(found.select("book_id")), "book_id", "left_semi")
    parts = parts.groupBy("book_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sort_order", "title", "summary"))),
            lambda c: F.struct(c["title"].alias("title"), c["summary"].alias("summary")),
        ).alias("chapters")
    )
    return found.join(parts, "book_id", "left")


def book_detail(books: DataFrame, chapters: DataFrame, book_id: str) -> DataFrame:
    """A book with its chapters but not their contents, which the scan leaves out."""
    return book_info(books.where(F.col("book_id") == book_id), chapters.drop("content"), "", 1)


def summarize_state(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """done, partial or none for each book."""
    some = chapters.groupBy("book_id").agg(F.max(F.col("summary") != "").alias("some"))
    state = F.when(F.col("summary") != "", "done").when(F.coalesce("some", F.lit(False)), "partial").otherwise("none")
    return books.join(some, "book_id", "left").select("book_id", state.alias("state"))


def active_task(tasks: DataFrame, book_id: str) -> DataFrame:
    """The first active one of a book's five newest tasks, with its label."""
    newest = tasks.where(F.col("book_id") == book_id).orderBy(F.desc("created_at"), "task_id").limit(5)
    stage = F.try_element_at("stages_log", F.lit(-1))["stage"]
    label = F.when((F.col("status") == "pending") & ~dispatched(), "queued").otherwise(F.coalesce(stage, "status"))
    return newest.where(F.col("status").isin(*ACTIVE)).orderBy(F.desc("created_at"), "task_id").limit(1).withColumn("label", label)


def dispatched() -> Column:
    return (F.col("type") != "ingest") | F.col("dispatched_at").isNotNull()


def past_sessions(sessions: DataFrame, keep: int = SESSIONS_KEPT) -> DataFrame:
    """Sessions beyond the newest ``keep`` of their user; ``keep`` <= 0 keeps all."""
    if keep <= 0:
        return sessions.limit(0)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "session_id"))
    return sessions.withColumn("place", place).where(F.col("place") > keep).drop("place")


def prune_sessions(sessions: DataFrame, messages: DataFrame, keep: int = SESSIONS_KEPT) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions that retention drops."""
    gone = past_sessions(sessions, keep).select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def without_books(rows: DataFrame, book_ids: Sequence[str]) -> DataFrame:
    return rows.where(~F.col("book_id").isin(*book_ids)) if book_ids else rows


def orphan_parts(parts: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks or vectors whose book is gone."""
    return parts.join(books.select("book_id"), "book_id", "left_anti")


def fill_if_empty(books: DataFrame, found: DataFrame, columns: Sequence[str] = ("title", "author", "language")) -> DataFrame:
    """Metadata found later fills only what is empty so far."""
    new = found.select("book_id", *(F.col(c).alias(f"new {c}") for c in columns))
    joined = books.join(new, "book_id", "left")
    for c in columns:
        empty = F.coalesce(c, F.lit("")) == ""
        joined = joined.withColumn(c, F.when(empty, F.coalesce(F.col(f"`new {c}`"), F.col(c))).otherwise(F.col(c)))
    return joined.select(*books.columns)


def edit_books(books: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the edited columns; a blank language leaves the old one."""
    columns = [c for c in edits.columns if c != "book_id"]
    new = edits.select("book_id", F.lit(True).alias("edited"), *(F.col(c).alias(f"new {c}") for c in columns))
    joined = books.join(new, "book_id", "left")
    for c in columns:
        value = F.col(f"`new {c}`")
        if c == "language":
            value = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.col(c)).otherwise(value)
        joined = joined.withColumn(c, F.when(F.col("edited"), value).otherwise(F.col(c)))
    return joined.select(*books.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; the last of equal keys (by seq) counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*(c for c in old.columns if c != key)), "seq").alias("row"))
    last = last.select(key, "row.*").select(*old.columns)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def replace_parts(rows: DataFrame, path: str, books: Sequence[str] = ()) -> None:
    """Replace all rows of the books in ``rows``, by overwriting just their partitions.

    ``books`` are ids to replace even by no rows: the partitions of those that ``rows`` lacks
    are deleted after the write.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)
    if books:
        spark = rows.sparkSession
        ids = spark.createDataFrame([(str(b),) for b in books], "book_id string")
        empty = ids.join(rows.select(F.col("book_id").cast("string").alias("book_id")), "book_id", "left_anti").distinct().collect()
        jvm = spark._jvm
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in empty:  # at most the caller's ids
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/book_id={escaped(row['book_id'])}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bulk(ids: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, ok, error) for each id of a bulk request."""
    known = books.select("book_id", F.lit(True).alias("ok"))
    done = F.coalesce("ok", F.lit(False))
    return ids.join(known, "book_id", "left").select(
        "book_id", done.alias("ok"), F.when(done, "").otherwise("book not found").alias("error")
    )


def last_admin(users: DataFrame, user_id: str) -> DataFrame:
    """One row: whether no other active admin is left."""
    others = (F.col("role") == "admin") & (F.col("status") == "active") & (F.col("user_id") != user_id)
    return users.agg((F.count(F.when(others, 1)) == 0).alias("last_admin"))


def lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    """At most one row by a key; the filter reaches the scan."""
    return rows.where(F.col(key) == value).limit(1)


def owns_session(sessions: DataFrame, session_id: str, user_id: str) -> DataFrame:
    """One row: whether the session is the user's."""
    mine = (F.col("session_id") == session_id) & (F.col("user_id") == user_id)
    return sessions.agg((F.count(F.when(mine, 1)) > 0).alias("owned"))


def taken(users: DataFrame, username: str) -> DataFrame:
    """One row: whether the name is in use."""
    return users.agg((F.count(F.when(F.col("username") == username, 1)) > 0).alias("taken"))


def selected(rows: DataFrame, ids: DataFrame, key: str = "book_id") -> DataFrame:
    """Listed rows among those selected."""
    return rows.join(ids.select(key), key, "left_semi")


def top_keywords(books: DataFrame, most: int = 50) -> DataFrame:
    """Each book's keywords by falling weight, ties by term, cut to ``most`` (<= 0: all)."""
    heavier = F.array_sort(
        F.transform("keywords", lambda k: F.struct((-k["weight"]).alias("order"), k["term"].alias("term"), k["weight"].alias("weight")))
    )
    kept = F.slice(heavier, 1, most) if most > 0 else heavier
    return books.withColumn("keywords", F.transform(kept, lambda k: F.struct(k["term"].alias("term"), k["weight"].alias("weight"))))


def parsed_tags(tags: Column) -> Column:
    """Tags from JSON text; what can't be read counts as none."""
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def audit_entry(rows: DataFrame, path: str) -> None:
    """Append to the audit log, which is never rewritten."""
    rows.write.mode("append").parquet(path)
