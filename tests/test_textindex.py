"""The kept index: a change equals a rebuild, bounds lose nothing, positions rank by nearness."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import retrieval, textindex

SCHEMA = "id string, book_id string, content string"


def texts(n, seed, books=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return [(f"{seed}-{k}", f"b{k % books}", " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for k in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    odd = [("null", None, None), ("empty", "b1", ""), ("same", "b1", "w1 w1 w2 W1"), ("far", "b2", "left " + "x " * 30 + "right"), ("close", "b2", "y left right y " + "x " * 30)]
    return spark.createDataFrame([*texts(700, 1), *odd], SCHEMA).cache()


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return textindex.build(chunks, f"file://{tmp_path_factory.mktemp('index')}/i")


def rows(frame, digits=9):
    return sorted((r["id"], round(r["raw"], digits)) for r in frame.collect())


def best(frame, k):
    return sorted(((-round(r["raw"], 9), r["id"]) for r in frame.collect()))[:k]


@pytest.mark.parametrize("query", ["w1 w7 w7 w55", "w0", "nowhere w3", "nowhere", ""])
def test_scores_equal_the_scan(chunks, index, query):
    assert rows(textindex.scores(index, query)) == rows(retrieval.bm25_scores(chunks, query))


@pytest.mark.parametrize("query, k", [("w30 w7", 5), ("w1 w2 w3", 40), ("w58 w59 w0", 3)])
def test_the_best_are_the_best_of_all(chunks, index, monkeypatch, query, k):
    want = best(retrieval.bm25_scores(chunks, query), k)
    assert best(textindex.topk(index, query, k), k) == want
    kept = [r["id"] for r in chunks.where("book_id in ('b1', 'b3')").select("id").collect()]
    want = best(retrieval.bm25_scores(chunks, query).where(F.col("id").isin(*kept)), k)
    assert best(textindex.topk(index, query, k, ["b1", "b3"]), k) == want


def test_blocks_that_cannot_reach_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 8)
    monkeypatch.setattr(textindex, "SHARE", 150)  # terms of several parts
    rng = random.Random(2)
    docs = [(f"{k}", "b", " ".join(["rare"] * (12 if k % 97 == 0 else rng.random() < 0.4) + ["pad"] * rng.randint(20, 90) + ["some"] * (k % 5 == 0))) for k in range(900)]
    frame = spark.createDataFrame(docs, SCHEMA)
    index = textindex.build(frame, f"file://{tmp_path}/i")
    asked = textindex._asked(index, "rare", textindex.tokens)
    lists = textindex._lists(index, ["rare"])
    wanted = textindex.wanted_blocks(index, lists, asked, 5, None).count()
    assert lists.select("part").distinct().count() > 1 and wanted < 0.5 * lists.count()
    for query in ("rare", "rare some"):
        assert best(textindex.topk(index, query, 5), 5) == best(retrieval.bm25_scores(frame, query), 5)


def test_a_change_equals_a_rebuild(spark, chunks, tmp_path):
    index = textindex.build(chunks, f"file://{tmp_path}/i")
    before = rows(textindex.scores(index, "w1 w9"))
    new = spark.createDataFrame([*((i, "b2", t) for i, _, t in texts(50, 9)), ("1-2", "b2", "w1 w9 back under an old id")], SCHEMA)
    changed = textindex.replace_books(index, new, ["b2", "b4", "absent"])
    changed = textindex.replace_books(changed, new.limit(0), ["b5"])
    left = chunks.where("book_id is null or book_id not in ('b2', 'b4', 'b5')").unionByName(new)
    for query in ("w1 w9", "w0 w59 back"):
        assert rows(textindex.scores(changed, query)) == rows(retrieval.bm25_scores(left, query))
        assert best(textindex.topk(changed, query, 7), 7) == best(retrieval.bm25_scores(left, query), 7)
    built = textindex.build(left, f"file://{tmp_path}/j")
    assert {k: changed.stats()[k] for k in ("n", "words")} == {k: built.stats()[k] for k in ("n", "words")}
    assert sorted(changed.table("terms").select("term", "df").collect()) == sorted(built.table("terms").select("term", "df").collect())
    assert rows(textindex.scores(index, "w1 w9")) == before  # the older state still reads what it read
    assert textindex.load(spark, f"file://{tmp_path}/i").state == changed.state


def test_neighbours_outrank_words_far_apart(index):
    found = [(r["id"], r["span"], r["raw"]) for r in textindex.near(index, "right left").collect()]
    assert found == [("close", 2, 1.0), ("far", 32, 2 / 32)]
    assert textindex.near(index, "left absent").count() == textindex.near(index, "").count() == 0
    assert textindex.near(index, "left right", book_ids=["b1"]).count() == 0


def test_only_folders_and_rows_of_the_terms_are_scanned(index):
    plan = textindex._lists(index, ["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(term,w1)" in plan and "content" not in plan


def test_an_empty_index(spark, tmp_path):
    empty = textindex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i")
    assert textindex.scores(empty, "w1").count() == textindex.topk(empty, "w1").count() == textindex.near(empty, "w1").count() == 0
    grown = textindex.replace_books(empty, spark.createDataFrame([("a", "b", "w1 w2"), ("c", "b", "w3")], SCHEMA), [])
    assert [r["id"] for r in textindex.topk(grown, "w1").collect()] == ["a"]


def test_equal_chunks_have_equal_scores(spark, tmp_path, monkeypatch):
    """Scores are added in one order, so ties go by id also where blocks, parts and generations differ."""
    monkeypatch.setattr(textindex, "BLOCK", 4)
    monkeypatch.setattr(textindex, "SHARE", 20)
    monkeypatch.setattr(textindex, "TOKENS", 50)
    said = [t for _, _, t in texts(40, 3) if t][:12]
    docs = [(f"{c}-{k}", f"b{c % 2}", t) for c in range(30) for k, t in enumerate(said)]
    index = textindex.build(spark.createDataFrame(docs[:200], SCHEMA).repartition(7), f"file://{tmp_path}/i")
    index = textindex.replace_books(index, spark.createDataFrame(docs[200:], SCHEMA), [])
    found = textindex.scores(index, "w0 w1 w2 w3 w4 w5 w6 w7 w8").collect()
    by_text = {}
    for r in found:
        by_text.setdefault(r["id"].split("-")[1], set()).add(r["raw"])
    assert by_text and all(len(v) == 1 for v in by_text.values())
    top = [r["id"] for r in textindex.topk(index, "w0 w1 w2 w3 w4 w5 w6 w7 w8", 20).collect()]
    assert top == sorted(top) and len({i.split("-")[1] for i in top}) == 1


def test_postings_are_shuffled_once(chunks):
    rows = textindex._blocks(textindex._positions(chunks, textindex.tokens), chunks.select(F.lit("w0").alias("term"), F.lit(1).alias("n")).limit(1))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_task_holds_few_postings_however_many_there_are(spark, chunks, tmp_path, monkeypatch):
    """A folder's postings are dealt out by slots, as many as its words ask for; a search finds them all."""
    monkeypatch.setattr(textindex, "FOLDERS", 2)
    monkeypatch.setattr(textindex, "SLOT", 300, raising=False)
    path = f"file://{tmp_path}/i"
    index = textindex.build(chunks, path)
    tasks = spark.read.parquet(f"{path}/postings/generation=0").groupBy(F.regexp_extract(F.input_file_name(), r"/part-(\d+)", 1).alias("task")).agg(F.sum("n").alias("n"))
    held = [r["n"] for r in tasks.collect()]
    assert sum(held) == sum(r["df"] for r in index.table("terms").collect()) and max(held) < 0.25 * sum(held)
    for query in ("w1 w7 w55", "w0"):
        assert rows(textindex.scores(index, query)) == rows(retrieval.bm25_scores(chunks, query))
        assert best(textindex.topk(index, query, 9), 9) == best(retrieval.bm25_scores(chunks, query), 9)
