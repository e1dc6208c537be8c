"""What must not be shuffled, kept in one batch or computed again and again as tables grow."""

from pyspark.sql import functions as F

from foliant.operators import chunking, keywords, retrieval
from foliant.plans import registry

from conftest import SF


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_counted_where_the_text_is(spark):
    texts = spark.createDataFrame([(1, "Pears and pears beat apples, plums"), (2, None), (None, "kiwi x kiwi"), (4, "")], "id int, text string")
    top = keywords.term_topk(texts, ["id"], 2)
    assert "Exchange" not in plan(top)
    got = sorted(map(tuple, top.collect()), key=str)
    assert got == [(1, "beat", 1.0, 2), (1, "pears", 2.0, 1), (None, "kiwi", 2.0, 1)]
    weighed = keywords.term_topk(texts, ["id"], 1, weight=spark.createDataFrame([("plums", 9.0), ("pears", 1.0)], "term string, idf double"))
    assert [tuple(r) for r in weighed.select("id", "term", "weight", "rank").collect()] == [(1, "plums", 9.0, 1)]


def test_rows_with_equal_keys_are_one_text(spark):
    texts = spark.createDataFrame([(1, "plum pear"), (1, "pear"), (2, "fig")], "id int, text string").repartition(3)
    got = {(r["id"], r["term"]): (r["weight"], r["rank"]) for r in keywords.term_topk(texts, ["id"], 5).collect()}
    assert got == {(1, "pear"): (2.0, 1), (1, "plum"): (1.0, 2), (2, "fig"): (1.0, 1)}


def test_segments_of_long_texts_leave_python_text_by_text(spark):
    rows = spark.createDataFrame([(k, f"c{k}", t) for k, t in enumerate([None, "", "short", "One. " * 700, "x" * 2500])], "book_id int, chapter_id string, content string")
    found = chunking.segments(rows, 1000, 1200)
    assert "ArrowEvalPython" not in plan(found)  # there, the segments of a whole batch of texts are held
    got = {}
    for r in sorted(found.collect()):
        got.setdefault((r["book_id"], r["chapter_id"]), []).append(r["segment"])
    assert got == {(k, f"c{k}"): chunking.cuts(t, 1000, 1200) for k, t in ((2, "short"), (3, "One. " * 700), (4, "x" * 2500))}


def test_a_search_scores_each_vector_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(v):
        seen.add(1)
        return v

    n = 60
    chunks = spark.createDataFrame([(str(k), "b", "word " * (k % 5)) for k in range(n)], "id string, book_id string, content string")
    vectors = spark.createDataFrame([(str(k), "b", [float(k - 30), 1.0]) for k in range(n)], "id string, book_id string, vector array<double>")
    vectors = vectors.withColumn("vector", counted("vector"))
    hits = retrieval.search(chunks, vectors, "word", lambda q: [1.0, 0.5], k=3)
    assert [r["id"] for r in hits.collect()] and seen.value == n


def test_files_are_parsed_once(spark):
    assert "ArrowEvalPython" not in plan(registry.queries()["ingest_vectors"](spark, SF))  # bytes are decoded before, into a table


def test_chunks_of_a_search_are_cut_once(spark):
    hits = registry.queries()["chunk_search"](spark, SF)
    assert "regexp_extract_all" not in plan(hits)
