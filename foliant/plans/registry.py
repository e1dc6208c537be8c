"""Registered queries by name; their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import catalog, cells, chunking, control, ingest, keywords, lattice, providers, qa, retrieval, summarize, textindex
from foliant.plans.oracles import ALL_TERMS_QUERY, CHUNK_QUERY, DOCUMENT_QUERY, MERGE_CAP, NOW, QUERY_VECTOR, SHORT
from foliant.sources import books as book_files
from foliant.sources import views as V
from foliant.streaming import control as streams
from foliant.streaming import timers

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Text -----------------------------------------------------------------------------------------


@query
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.regexp_replace("text", r"\n", " \t\n\n\n\n"), F.lit(" \n"))
    return V.table(spark, sf_dir, "documents").select("doc_id", T.clean_whitespace(messy).alias("clean"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunks(spark, sf_dir).select("book_id", "position", "content", "token_count")


@query
def chunk_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions counted through books of many chapters."""
    docs = V.table(spark, sf_dir, "documents")
    chapters = docs.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").cast("string").alias("chapter_id"),
        F.col("doc_id").alias("sort_order"),
        F.col("text").alias("content"),
    )
    return chunking.chunks(chapters, 300, 30).select("book_id", "chapter_id", "position", "token_count")


@query
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.col("text").alias("content"))
    return chunking.segments(rows, SHORT[0], SHORT[1]).select(
        F.col("chapter_id").alias("doc_id"), "segment_no", F.length("segment").alias("n"), "segment"
    )


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a preface, two headings and an index."""
    docs = V.table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("before\n  Chapter 1 The Text \n"), F.coalesce("text", F.lit("")), F.lit("\nchapter 2\n\nnotes on "), "doc_id", F.lit("\nChapter 3 None\n \nIndex\n")
    )
    return docs.select(F.col("doc_id").alias("book_id"), F.lit("My Book").alias("title"), body.alias("content"))


@query
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunking.chapters_of_text(_headed(spark, sf_dir))
    return parts.select("book_id", "title", "sort_order", "content")


@query
def chapter_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _headed(spark, sf_dir).select("book_id", "title", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return chunking.chapters_of_lines(lines).select("book_id", "title", "sort_order", "content")


@query
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned titles, back matter, copyright titles."""
    docs = V.table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 7 == 0, " In dex").when(F.col("doc_id") % 7 == 1, " Copyright page ").otherwise(
        F.substring("text", 1, 30)
    )
    return docs.select(
        "doc_id",
        T.clean_title(title).alias("title"),
        T.is_back_matter(title).alias("back_matter"),
        T.is_copyright_title(title).alias("copyright"),
    )


@query
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    tail = F.element_at(F.array(*map(F.lit, ("", "史", "機", "の", "é", "书"))), (F.col("doc_id") % 6 + 1).cast("int"))
    title = F.concat(F.substring("text", 1, 3), tail)
    code = T.book_language(F.lit(""), title)
    return docs.select(
        "doc_id", code.alias("code"), T.language_bucket(code).alias("bucket"), T.language_name(code).alias("name")
    )


@query
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    vector = providers.embed_chunks(docs).select("doc_id", F.posexplode("vector").alias("at", "value"))
    return vector


@query
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    token = F.concat(F.lit("token-"), "doc_id")
    return docs.select("doc_id", T.token_digest(token).alias("digest"), T.mask_token(token).alias("masked"))


@query
def html_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_files.html_blocks(V.table(spark, sf_dir, "pages")).select("page_id", "text")


# Retrieval ------------------------------------------------------------------------------------


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_topk(V.vectors(spark, sf_dir), QUERY_VECTOR, 10).select("id", r6("score").alias("score"))


@query
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.cosine_topk(V.vectors(spark, sf_dir), QUERY_VECTOR, 7, ["src1", "src3"])
    return top.select("id", "book_id" if "book_id" in top.columns else F.lit("").alias("book_id"), r6("score").alias("score"))


@query
def cosine_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cells give the exact rows where all of them are read."""
    index = cells.build(V.vectors(spark, sf_dir), streams.scratch(spark, "cells"))
    return cells.topk(index, QUERY_VECTOR, 7, ["src1", "src3"], share=1.0).select("id", r6("score").alias("score"))


@query
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_scores(V.corpus(spark, sf_dir), DOCUMENT_QUERY).select("id", r6("raw").alias("raw"))


@query
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = retrieval.of_books(V.corpus(spark, sf_dir), ["src1", "src3"])
    return retrieval.relative(retrieval.bm25_scores(some, DOCUMENT_QUERY)).select("id", r6("score").alias("score"))


@query
def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.postings(V.corpus(spark, sf_dir))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def _text_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """An index of half the documents to which a change adds the others and takes the old ones of two sources."""
    docs = V.corpus(spark, sf_dir)
    index = textindex.build(docs.where("cast(id as long) % 2 = 0 or book_id in ('src1', 'src3')").withColumn("id", F.concat("id", F.when(F.col("book_id").isin("src1", "src3"), "old").otherwise(""))), streams.scratch(spark, "index"))
    return textindex.replace_books(index, docs.where("cast(id as long) % 2 = 1 or book_id in ('src1', 'src3')"), ["src1", "src3"])


@query
def index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from the kept index after a change equals that over the corpus."""
    return textindex.scores(_text_index(spark, sf_dir), DOCUMENT_QUERY).select("id", r6("raw").alias("raw"))


@query
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.topk(_text_index(spark, sf_dir), DOCUMENT_QUERY, 12).select("id", r6("raw").alias("raw"))


@query
def index_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.near(_text_index(spark, sf_dir), ALL_TERMS_QUERY, 25).select("id", "span", r6("raw").alias("raw"))


@query
def fulltext_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fulltext_scores(V.corpus(spark, sf_dir), ALL_TERMS_QUERY, 20).select("id", r6("raw").alias("raw"))


def _hybrid(spark: SparkSession, sf_dir: str, threshold: float = 0.0, k: int = 10) -> DataFrame:
    return retrieval.search(
        V.corpus(spark, sf_dir), V.vectors(spark, sf_dir), DOCUMENT_QUERY, lambda q: QUERY_VECTOR, k=k, threshold=threshold
    )


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("id", r6("vector_score").alias("v"), r6("keyword_score").alias("k"), r6("score").alias("score"))


@query
def hybrid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 0.25, 1000).select("id", r6("score").alias("score"))


@query
def hybrid_keyword_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fails(q: str) -> list[float]:
        raise providers.ServiceCallError.of_status("embedding", None)

    hits = retrieval.search(V.corpus(spark, sf_dir), V.vectors(spark, sf_dir), DOCUMENT_QUERY, fails, k=10)
    return hits.select("id", r6("score").alias("score"))


@query
def hybrid_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.search(
        V.corpus(spark, sf_dir), V.vectors(spark, sf_dir), DOCUMENT_QUERY, lambda q: QUERY_VECTOR, k=10, fulltext=True
    )
    return hits.select("id", r6("score").alias("score"))


@query
def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir).select("book_id", "title")
    names = V.corpus(spark, sf_dir).select("book_id").distinct().where("book_id != 'src3'").select("book_id", F.upper("book_id").alias("title"))
    chapters = books.select(F.col("book_id").alias("chapter_id"), "title")
    hits = retrieval.enrich(_hybrid(spark, sf_dir), names, chapters)
    return hits.select("id", "book_title", "chapter_title", r6("score").alias("score"))


@query
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.context(_hybrid(spark, sf_dir, k=5))


@query
def rag_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.citations(_hybrid(spark, sf_dir, k=5)).withColumn("score", r6("score"))


def _written(rows: DataFrame, tag: str) -> DataFrame:
    """The rows as they are read again from a table."""
    path = streams.scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: clean, chunk, embed by hash, search."""
    docs = V.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("book_id"), T.clean_whitespace(F.col("text")).alias("content"))
    chunks = _written(chunking.document_chunks(rows).withColumnRenamed("chunk_id", "id"), "chunks")  # search reads them several times
    vectors = providers.embed_chunks(chunks).select("id", "book_id", "vector")
    hits = retrieval.search(chunks, vectors, CHUNK_QUERY, lambda q: providers.HashEmbedder().embed([q])[0], k=10)
    return hits.select("id", "book_id", "position", r6("score").alias("score"))


@query
def ingest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files through parsing, cleaning, chunking and embedding: one row a chunk."""
    docs = _headed(spark, sf_dir)
    files = docs.select(F.concat(F.lit("/books/"), "book_id", F.lit(".txt")).alias("path"), F.encode("content", "utf-8").alias("content"))
    vectors = ingest.ingest(_written(book_files.read_text(files), "parsed")).vectors  # numbering and cutting both read the chapters
    return vectors.select("id", "book_id", "chapter_id", "content", "position", "token_count", F.col("vector")[0].alias("first"))


# Keywords and summaries -----------------------------------------------------------------------


@query
def learnt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, found again where their letters are Han characters and the spaces are gone."""
    words = lattice.learn(V.unspaced(spark, sf_dir), longest=3, least=20)
    return words.select("word", "n", r6("cohesion").alias("cohesion"), r6("freedom").alias("freedom"))


@query
def keywords_tf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.term_topk(V.table(spark, sf_dir, "documents"), ["doc_id"], 5)


@query
def keywords_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts weighed by what the corpus says of each term."""
    docs = V.table(spark, sf_dir, "documents")
    top = keywords.term_topk(docs, ["doc_id"], 5, weight=keywords.inverse_frequencies(docs))
    return top.select("doc_id", "term", r6("weight").alias("weight"), "rank")


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("sort_order"), F.lit(0).alias("segment_no"), "text")
    return keywords.term_topk(rows, ["book_id", "sort_order", "segment_no"], k)


@query
def keywords_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold with a small cap."""
    return keywords.rolling_merge(_candidates(spark, sf_dir, 3), MERGE_CAP)


@query
def keywords_merged_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.merged_sum(_candidates(spark, sf_dir, 3))


@query
def keyword_cloud_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = keywords.term_topk(V.table(spark, sf_dir, "documents"), ["doc_id"], 5)
    return keywords.cloud_tiers(top, "doc_id").select("doc_id", "term", "tier", r6("scale").alias("scale"))


@query
def summaries_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter summaries of whole texts by the stand-in model; long chapters are summarised by segment and merged."""
    docs = V.table(spark, sf_dir, "documents")
    chapters = docs.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("chapter_id"),
        F.col("doc_id").alias("sort_order"),
        F.concat(F.lit("t"), "doc_id").alias("title"),
        F.col("text").alias("content"),
    )
    done = summarize.chapter_summaries(chapters, providers.ExtractiveModel(60), "en")
    return done.select("book_id", "chapter_id", "sort_order", "summary")


@query
def pseudo_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir).select("book_id", "summary")
    parts = books.select("book_id", F.concat("book_id", F.lit("#0")).alias("chapter_id"), "summary")
    return summarize.pseudo_chunks(parts, books)


# Catalog --------------------------------------------------------------------------------------


@query
def books_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = catalog.list_books(V.books(spark, sf_dir), status="ready", page=catalog.Page(2, 15))
    return page.select("book_id", "title", "language", "status", "created_at")


@query
def books_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_books(V.books(spark, sf_dir), q="SRC1_", page=catalog.Page(0, 999)).select("book_id", "author")


@query
def books_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filter_books(V.books(spark, sf_dir), q="th%e").agg(F.count("*").alias("total"))


@query
def chunks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_chunks(V.chunks(spark, sf_dir), "21", number=2, size=3).select("chunk_id", "position", "content")


@query
def tasks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_tasks(V.tasks(spark, sf_dir), status="pending").select("task_id", "book_id", "created_at")


@query
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_audit(V.audit(spark, sf_dir), catalog.Page(3, 25)).select("entry_id", "actor", "action", "detail")


@query
def sessions_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_sessions(V.sessions(spark, sf_dir), "u3").select("session_id", "updated_at")


@query
def messages_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_messages(V.messages(spark, sf_dir), "7").select("seq", "role", "content")


@query
def books_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_by(V.books(spark, sf_dir))


@query
def status_bar_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.count_by(V.books(spark, sf_dir))
    top = n.agg(F.greatest(F.lit(1), F.max("n")).alias("top"))
    return n.join(F.broadcast(top), how="cross").select("status", r6(F.col("n") / F.col("top") * 100).alias("pct"))


@query
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dashboard(*(v(spark, sf_dir) for v in (V.books, V.chunks, V.sessions, V.tasks)))


@query
def running_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.running_ingests(V.tasks(spark, sf_dir))


@query
def book_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir)
    chapters = books.select("book_id", F.lit(0).alias("sort_order"), "title", "summary")
    chapters = chapters.unionByName(books.select("book_id", F.lit(1).alias("sort_order"), F.lit("more").alias("title"), F.lit("").alias("summary")))
    found = catalog.book_info(books, chapters, "src4")
    return found.select("book_id", F.array_join(F.transform("chapters", lambda c: F.concat_ws("/", c["title"], c["summary"])), "|").alias("chapters"))


@query
def summarize_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir).withColumn("summary", F.when(F.col("created_at") % 3 == 0, F.col("summary")).otherwise(""))
    chapters = V.books(spark, sf_dir).select("book_id", "summary")
    return catalog.summarize_state(books, chapters)


@query
def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, said = catalog.prune_sessions(V.sessions(spark, sf_dir), V.messages(spark, sf_dir), 3)
    return said.groupBy("session_id").agg(F.count("*").alias("messages")).join(kept, "session_id").select("session_id", "user_id", "messages")


@query
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = catalog.without_books(V.books(spark, sf_dir), ["3", "5", "8"])
    return catalog.orphan_parts(V.chunks(spark, sf_dir), left).select("chunk_id", "book_id")


@query
def metadata_fill_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir).select("book_id", F.when(F.col("status") == "failed", "").otherwise(F.col("title")).alias("title"), "author", "language")
    found = V.books(spark, sf_dir).where("language = 'eng'").select("book_id", F.lit("found").alias("title"), F.lit("x").alias("author"), F.lit("y").alias("language"))
    return catalog.fill_if_empty(books, found)


@query
def book_upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = V.table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("id"), (F.col("event_id") % 7).cast("int").alias("label"), F.col("event_id").alias("seq"))
    return catalog.upsert(old, new)


@query
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.table(spark, sf_dir, "events").select((F.col("user_id") * 11).cast("string").alias("book_id")).distinct()
    return catalog.bulk(ids, V.books(spark, sf_dir))


@query
def citation_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir).select(F.col("author").alias("book_id")).where("book_id != 'src3'").distinct()
    books = books.select("book_id", F.upper("book_id").alias("title"))
    chapters = V.books(spark, sf_dir).where("language = 'eng'").select(F.col("book_id").alias("chapter_id"), "title")
    return qa.cited_titles(qa.citations(_hybrid(spark, sf_dir, k=5)), books, chapters)


@query
def book_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(V.books(spark, sf_dir), "book_id", "17").select("book_id", "title", "status")


@query
def session_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.owns_session(V.sessions(spark, sf_dir), "3", "u3")


@query
def books_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("book_id"))
    return catalog.selected(V.books(spark, sf_dir), ids).select("book_id", "status")


@query
def keywords_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = keywords.term_topk(V.table(spark, sf_dir, "documents"), ["doc_id"], 6)
    books = top.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("keywords"))
    shown = catalog.top_keywords(books, 3)
    return shown.select("doc_id", F.array_join(F.transform("keywords", lambda k: k["term"]), ",").alias("terms"))

@query
def chapters_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_chapters(V.chapters(spark, sf_dir), "b3").select("chapter_id", "sort_order", "title")


@query
def tokens_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_tokens(V.tokens(spark, sf_dir), "7").select("token_id", "created_at", "is_revoked")


@query
def users_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_users(V.users(spark, sf_dir), catalog.Page(2, 20)).select("user_id", "username", "role", "status")


@query
def queued_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.oldest_queued(V.tasks(spark, sf_dir), 3).select("task_id", "book_id")


@query
def orphan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orphans(V.tasks(spark, sf_dir), "summarize").select("task_id", "status")


@query
def tokens_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.valid_tokens(V.tokens(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("token_id", "expires_at")


@query
def last_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_admin(V.users(spark, sf_dir), "50")


@query
def name_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.taken(V.users(spark, sf_dir), "Customer#000000007")


@query
def book_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("status") == "ready", F.concat(F.lit("covers/"), "book_id")).otherwise(" ")
    return catalog.has_cover(V.books(spark, sf_dir).withColumn("cover_path", path), "17")


@query
def active_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task a book's page shows, with its label."""
    log = F.array(F.struct(F.lit("parse").alias("stage")), F.struct(F.lit("embed").alias("stage")))
    tasks = V.tasks(spark, sf_dir).withColumn("stages_log", F.when(F.col("progress") % 2 == 0, log).otherwise(F.slice(log, 1, 0)))
    return catalog.active_task(tasks, "7").select("task_id", "status", "label")


@query
def book_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.books(spark, sf_dir).withColumn("book_id", F.concat(F.lit("b"), "book_id"))
    found = catalog.book_detail(books, V.chapters(spark, sf_dir), "b4")
    return found.select("book_id", F.explode("chapters").alias("c")).select("book_id", "c.title", "c.summary")


@query
def book_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["a","t'), "doc_id", F.lit('"]'))).when(F.col("doc_id") % 3 == 1, "no list")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(catalog.parsed_tags(tags), "|").alias("tags"))


@query
def books_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank language leaves the old one."""
    books = V.books(spark, sf_dir).select("book_id", "title", "author", "language")
    edits = V.books(spark, sf_dir).where("status = 'failed'").select(
        "book_id", F.concat(F.lit("new "), "book_id").alias("title"), F.when(F.col("created_at") % 2 == 0, " ").otherwise("ita").alias("language")
    )
    return catalog.edit_books(books, edits)


@query
def users_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = V.users(spark, sf_dir).select("user_id", "role", "status")
    changes = V.tokens(spark, sf_dir).select(
        "user_id", F.lit("user").alias("role"), F.when(F.col("is_revoked"), "disabled").otherwise("active").alias("status"), F.col("token_id").cast("long").alias("seq")
    )
    return catalog.upsert(users, changes, "user_id")


@query
def parts_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts are stored by book; then one book gets other parts, one none."""
    path = streams.scratch(spark, "parts")
    docs = V.table(spark, sf_dir, "documents")
    parts = docs.select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("chapter_id"))
    catalog.replace_parts(parts, path)
    other = parts.where("book_id = 'src1'").select("book_id", F.concat(F.lit("new "), "chapter_id").alias("chapter_id"))
    catalog.replace_parts(other, path, ["src1", "src2"])
    return spark.read.schema("chapter_id string, book_id string").parquet(path)


@query
def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after two entries of rows; the first stays."""
    path = streams.scratch(spark, "audit")
    log = V.audit(spark, sf_dir)
    catalog.audit_entry(log, path)
    catalog.audit_entry(log.where("action = 'error'").withColumn("action", F.lit("seen")), path)
    return spark.read.schema(log.schema).parquet(path).groupBy("action").agg(F.count("*").alias("n"), F.max("entry_id").alias("last"))


@query
def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = catalog.count_map(V.books(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return counts.select(shown.alias("by_status"), "total")


# Control --------------------------------------------------------------------------------------


@query
def task_stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = control.stage_logs(V.task_events(spark, sf_dir))
    log = F.array_join(F.transform("stages_log", lambda e: F.concat_ws(":", e["stage"], e["progress"])), ",")
    return rows.select("task_id", "status", "progress", "error_msg", "stage", log.alias("log"))


@query
def task_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.final_states(V.task_events(spark, sf_dir))


@query
def dispatch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap leaves four places beside the tasks that run."""
    tasks = V.tasks(spark, sf_dir)
    running = catalog.running_ingests(tasks).first()[0]
    return control.dispatch(tasks, running + 4).select("task_id", "created_at")


@query
def orphan_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.recover(V.tasks(spark, sf_dir)).select("task_id", "type", "status", "progress", "logged", F.col("dispatched_at").isNull().alias("queued"))


@query
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are sparse, so the bucket is smaller and refills by the hour."""
    return control.rate_limit(V.requests(spark, sf_dir), 3.0, 1 / 3600)


@query
def active_sessions_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"))
    now = F.lit(NOW).cast("timestamp_ntz")
    return control.active_sessions(rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), now).select("event_id")


@query
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = V.requests(spark, sf_dir).select(F.col("client").alias("task_id"), "ts", F.col("event_id").alias("seq"))
    return control.throttle(ticks, 3600.0)

@query
def book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = V.tasks(spark, sf_dir).withColumn("created_at", F.col("task_id").cast("long"))  # times may be equal, ids are not
    return control.book_states(V.books(spark, sf_dir), tasks).select("book_id", "status")


@query
def tasks_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [str(n) for n in range(0, 60)]
    return control.retry(V.tasks(spark, sf_dir), asked).select("task_id", "status", "progress", F.col("dispatched_at").isNull().alias("queued"))


@query
def progress_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, total = F.col("event_id") % 40, F.col("user_id") % 40
    return V.table(spark, sf_dir, "events").select(
        "event_id", control.ingest_progress(done, total).alias("ingest"), control.summarize_progress(done, total).alias("summarize")
    )


# Streams --------------------------------------------------------------------------------------


@query
def stream_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.event_stream(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    events = e.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.col("event_type").alias("stage"),
        (F.col("event_id") % 100).cast("int").alias("progress"),
    )
    return streams.run_query(streams.task_states(events), "task-states", "update", ["task_id"])


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.event_stream(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("client"), "event_id", (V.micros("ts") / 1e6).alias("ts"))


@query
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_query(streams.rate_limit(_request_stream(spark, sf_dir), 3.0, 1 / 3600), "rate-limit")


@query
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of users; the open ones are state."""
    rows = streams.run_query(streams.sessions_alive(_request_stream(spark, sf_dir), 24), "sessions")
    return rows.select("client", r6("opened_at").alias("opened_at"), "n")


@query
def stream_sessions_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a later event or the passing of time ends."""
    logins = streams.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("client"), F.timestamp_micros(V.micros("ts")).alias("ts"))
    rows = timers.run(timers.sessions(logins, 24), "sessions-ended")
    return rows.select("client", F.unix_micros("opened_at").alias("opened_at"), "n")


@query
def stream_lost_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without an event for two days."""
    rows = timers.run(timers.lost_tasks(V.heartbeats(streams.event_stream(spark, sf_dir)), 2_880.0), "lost-tasks")
    return rows.select("task_id", F.unix_micros("last_seen").alias("last_seen"), "action")


@query
def lost_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a batch, as known an hour before the last event."""
    events = V.heartbeats(V.table(spark, sf_dir, "events"))
    until = events.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("until"))
    rows = timers.lost_tasks_batch(events.join(F.broadcast(until), how="cross"), F.col("until"), 2_880.0)
    return rows.select("task_id", F.unix_micros("last_seen").alias("last_seen"), "action")
