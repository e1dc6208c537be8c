"""Hybrid retrieval: exact cosine and BM25 or full-text relevance, fused and cut to the best."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.functions.vectors import cosine

log = logging.getLogger(__name__)

VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.6, 0.4
K1, B, EPSILON = 1.5, 0.75, 0.25
Tokenizer = Callable[[Column], Column]


def of_books(rows: DataFrame, book_ids: Sequence[str] | None) -> DataFrame:
    """Rows of the books asked for; none asked for means all."""
    return rows.where(F.col("book_id").isin(*book_ids)) if book_ids else rows


def query_tokens(spark, query: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(term, times) of a query: one row a distinct token."""
    one = spark.range(1).select(F.explode(tokenizer(F.lit(query))).alias("term"))
    return one.groupBy("term").agg(F.count("*").cast("double").alias("times"))


def cosine_scores(vectors: DataFrame, query: Sequence[float], book_ids: Sequence[str] | None = None) -> DataFrame:
    """(id, score) by exact cosine with the query vector; no sort yet."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return of_books(vectors, book_ids).select("id", cosine(F.col("vector"), q).alias("score"))


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int = 10, book_ids: Sequence[str] | None = None) -> DataFrame:
    """The k nearest, ties by id: a top-k heap in each task, never a full sort."""
    return cosine_scores(vectors, query, book_ids).orderBy(F.desc("score"), "id").limit(k)


def postings(chunks: DataFrame, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(id, book_id, term, tf, doc_len): the inverted index as a table, to be written once and read by query."""
    split = chunks.select("id", "book_id", tokenizer(F.col("content")).alias("tokens"))
    return (
        split.select("id", "book_id", F.size("tokens").cast("double").alias("doc_len"), F.explode("tokens").alias("term"))
        .groupBy("id", "book_id", "doc_len", "term")
        .agg(F.count("*").cast("double").alias("tf"))
    )


def bm25_scores(chunks: DataFrame, query: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(id, raw) of every chunk that holds a term of the query, by Okapi BM25 over these chunks.

    An inverse document frequency below zero becomes EPSILON times the average of all terms'.
    A query that repeats a term counts it as often. Only the query's terms are scored; what the
    statistics need of all other terms is one count a term. The query's own terms are few and
    are broadcast.
    """
    spark = chunks.sparkSession
    split = chunks.select("id", tokenizer(F.col("content")).alias("tokens"))
    corpus = split.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("tokens").cast("double")).alias("avgdl"))
    df = split.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term")
    df = df.agg(F.count("*").cast("double").alias("df"))
    idf = df.join(F.broadcast(corpus), how="cross").select(  # one row
        "term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")
    )
    floor = idf.agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = F.broadcast(query_tokens(spark, query, tokenizer))
    terms = idf.join(asked, "term").join(F.broadcast(floor), how="cross")
    terms = terms.select("term", "times", "avgdl", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    words = spark.range(1).select(tokenizer(F.lit(query)).alias("words"))
    found = split.join(F.broadcast(words), how="cross").select(
        "id", F.size("tokens").cast("double").alias("len"), F.explode(F.filter("tokens", lambda t: F.array_contains("words", t))).alias("term")
    )
    tf = found.groupBy("id", "len", "term").agg(F.count("*").cast("double").alias("tf"))
    part = (
        F.col("times")
        * F.col("idf")
        * (F.col("tf") * (K1 + 1.0))
        / (F.col("tf") + K1 * (F.lit(1.0 - B) + B * F.col("len") / F.col("avgdl")))
    )
    return tf.join(F.broadcast(terms), "term").groupBy("id").agg(F.sum(part).alias("raw"))


def relative(scores: DataFrame) -> DataFrame:
    """(id, score): raw scores over the largest; no rows at all if that is not above zero.

    A chunk that no term hits has raw score 0, so where only negative scores exist the largest
    is 0 and there is no keyword signal.
    """
    top = scores.agg(F.max("raw").alias("top"))
    return scores.join(F.broadcast(top), how="cross").where("top > 0").select("id", (F.col("raw") / F.col("top")).alias("score"))


def fulltext_scores(chunks: DataFrame, query: str, k: int = 20, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(id, raw) of the best k chunks that hold all terms of the query.

    The rank is the sum of tf / (tf + 1) over the query's terms, a stand-in for a proximity
    rank; matching is exact.
    """
    words = chunks.sparkSession.range(1).select(F.array_distinct(tokenizer(F.lit(query))).alias("words"))
    split = chunks.select("id", tokenizer(F.col("content")).alias("tokens")).join(F.broadcast(words), how="cross")
    held = split.where((F.size("words") > 0) & (F.size(F.array_except("words", "tokens")) == 0))

    def weight(term: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda t: t == term)).cast("double")
        return tf / (tf + 1.0)

    rank = F.aggregate(F.transform("words", weight), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return held.select("id", rank.alias("raw")).orderBy(F.desc("raw"), "id").limit(k if k > 0 else 20)


def fuse(
    corpus: DataFrame, vector: DataFrame | None, keyword: DataFrame, k: int = 10, threshold: float = 0.0
) -> DataFrame:
    """Weighted sum of both signals for every record, best first.

    ``corpus`` has one row an id and more columns; a missing score is 0. Without any vector
    scores the keyword score stands alone. The threshold is inclusive; ties go by id. Ids and
    scores alone are joined and cut to the best k, which are then broadcast to fetch the other
    columns, so contents never move.
    """
    ids = corpus.select("id")
    keyword = keyword.select("id", F.col("score").alias("keyword_score"))
    if vector is None:
        scored = ids.withColumn("vector_score", F.lit(0.0)).withColumn("share", F.lit(0.0))
    else:
        vector = vector.select("id", F.col("score").alias("vector_score"))
        some = vector.agg(F.when(F.count("*") > 0, VECTOR_WEIGHT).otherwise(0.0).alias("share"))
        scored = ids.join(vector, "id", "left").join(F.broadcast(some), how="cross")
    scored = scored.join(keyword, "id", "left")
    scored = scored.withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0)))
    scored = scored.withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    total = VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.col("keyword_score")
    scored = scored.withColumn("score", total / (F.col("share") + KEYWORD_WEIGHT)).drop("share")
    best = scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k if k > 0 else 10)
    if corpus.columns == ["id"]:
        return best
    return corpus.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")


#: Rows of each signal that ``best_fused`` looks at before it leaves the work to ``fuse``.
MOST_SEEN = 20_000


def best_fused(corpus: DataFrame, vector: DataFrame | None, keyword: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The rows of ``fuse`` by a threshold algorithm: no id of the corpus is shuffled.

    The best rows of both signals are looked at, k at first. A record among neither has at most the
    worst scores seen, so once k records of the corpus are above what these give, they are the
    best. Else more rows are looked at; where that doesn't end the work is ``fuse``'s. At most
    MOST_SEEN rows of a signal are on the driver. Both signals are read several times and should
    be cheap to read; runs at once, unlike ``fuse``.
    """
    spark, kind = corpus.sparkSession, dict(corpus.dtypes)["id"]
    k = k if k > 0 else 10
    size = k

    def top(scores: DataFrame | None) -> list[tuple]:
        return [] if scores is None else [tuple(r) for r in scores.select("id", "score").orderBy(F.desc("score"), "id").limit(size).collect()]

    def of(scores: DataFrame | None, ids: DataFrame) -> dict:
        return {} if scores is None else {r[0]: r[1] for r in scores.select("id", "score").join(F.broadcast(ids), "id", "left_semi").collect()}

    while size <= MOST_SEEN:
        near, said = top(vector), top(keyword)
        if any(x is None or x != x for _, x in (*near, *said)):
            break
        # what a record among neither can have: the last score seen, or 0 where it has none
        bounds = [max(0.0, rows[-1][1]) if len(rows) == size else 0.0 for rows in (near, said)]
        seen = {i for i, _ in (*near, *said)}
        ids = spark.createDataFrame([(i,) for i in seen], f"id {kind}")
        v, kw = of(vector, ids), of(keyword, ids)
        inside = [r["id"] for r in corpus.select("id").join(F.broadcast(ids), "id", "left_semi").collect()]
        share = (VECTOR_WEIGHT if near else 0.0) + KEYWORD_WEIGHT

        def total(a: float, b: float) -> float:
            return (VECTOR_WEIGHT * a + KEYWORD_WEIGHT * b) / share

        rows = sorted(((i, v.get(i, 0.0), kw.get(i, 0.0), total(v.get(i, 0.0), kw.get(i, 0.0))) for i in inside), key=lambda r: (-r[3], r[0]))
        least = total(*bounds)
        good = [r for r in rows if r[3] >= threshold][:k]
        if (len(good) == k and good[-1][3] > least) or least < threshold:
            best = spark.createDataFrame(good, f"id {kind}, vector_score double, keyword_score double, score double")
            if corpus.columns == ["id"]:
                return best.orderBy(F.desc("score"), "id")
            return corpus.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")
        if len(near) < size and len(said) < size:
            break  # the rest are records without any signal
        size *= 8
    return fuse(corpus, vector, keyword, k, threshold)


def search(
    chunks: DataFrame,
    vectors: DataFrame,
    query: str,
    embed_query: Callable[[str], Sequence[float]],
    book_ids: Sequence[str] | None = None,
    k: int = 10,
    threshold: float = 0.0,
    fulltext: bool = False,
    tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """Hybrid search. An embedder that fails leaves the keyword signal alone; where the full-text signal
    can't be had, also at run time, BM25 stands in for it. Ids and scores of both signals are kept while they are read."""
    corpus = of_books(chunks, book_ids)
    try:
        near = cosine_scores(vectors, embed_query(query), book_ids).persist()  # (id, score), read several times
    except Exception:  # the provider may be out of reach
        log.exception("no query vector")
        near = None
    raw = None
    if fulltext:
        try:
            raw = fulltext_scores(corpus, query, max(4 * k, 50), tokenizer).persist()
            raw.count()  # the job may fail as well as the plan
        except Exception:
            log.exception("no full-text scores")
            raw = None
    if raw is None:
        raw = bm25_scores(corpus, query, tokenizer).persist()  # (id, score) of the hits, read several times
    found = best_fused(corpus, near, relative(raw), k, threshold)
    for kept in (raw, near):  # a result that still needs them computes them again
        if kept is not None:
            kept.unpersist()
    return found


def enrich(hits: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Hits with the titles of their books and chapters; unknown ones are empty.

    The hits are few (at most k), so they are what is broadcast, not the tables.
    """
    titles = books.select("book_id", F.col("title").alias("book_title"))
    parts = chapters.select("chapter_id", F.col("title").alias("chapter_title"))
    few = F.broadcast(hits)
    with_book = few.join(titles.join(F.broadcast(hits.select("book_id").distinct()), "book_id", "left_semi"), "book_id", "left")
    both = with_book.join(
        parts.join(F.broadcast(hits.select("chapter_id").distinct()), "chapter_id", "left_semi"), "chapter_id", "left"
    )
    return both.withColumn("book_title", F.coalesce("book_title", F.lit(""))).withColumn(
        "chapter_title", F.coalesce("chapter_title", F.lit(""))
    )
