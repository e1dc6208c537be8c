"""Inverted cells: recall, what is read, filters, changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import cells, retrieval

DIMENSIONS, TOPICS, ROWS = 32, 60, 6000


@pytest.fixture(scope="module")
def planted(spark):
    """Vectors around topics, as embeddings of texts are, twenty books across all topics, and rows without a direction."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(TOPICS, DIMENSIONS))
    x = centres[rng.integers(0, TOPICS, ROWS)] + 0.35 * rng.normal(size=(ROWS, DIMENSIONS))
    rows = [(f"v{k}", f"b{k % 20}", [float(a) for a in v]) for k, v in enumerate(x)]
    rows += [("zero", "b1", [0.0] * DIMENSIONS), ("none", "b1", None), ("nan", "b2", [float("nan")] * DIMENSIONS), ("odd", None, rows[0][2])]
    return spark.createDataFrame(rows, "id string, book_id string, vector array<double>"), x


@pytest.fixture(scope="module")
def index(planted, tmp_path_factory):
    return cells.build(planted[0], f"file://{tmp_path_factory.mktemp('cells')}/index")


def ids(rows):
    return [r["id"] for r in rows.collect()]


def test_recall_with_a_tenth_of_the_rows_read(planted, index):
    vectors, x = planted
    for books in (None, ["b3", "b7"]):
        hits, read = 0, 0
        total = retrieval.of_books(vectors, books).count()
        for k in range(6):
            q = x[k * 97].tolist()
            hits += len(set(ids(cells.topk(index, q, 10, books))) & set(ids(retrieval.cosine_topk(vectors.where(cells.directed()), q, 10, books))))
            some = cells.probes(index, q, 10, books, cells.SHARE)
            read += retrieval.of_books(index.vectors.where(F.col("cell").isin(*some)), books).count()
        assert hits >= 0.95 * 60 and read <= 6 * (0.1 * total + 2 * total / np.sqrt(ROWS))


def test_only_the_cells_asked_for_are_scanned(index, planted, spark):
    plan = cells.topk(index, planted[1][5].tolist(), 10, ["b3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "In(book_id" in plan or "EqualTo(book_id" in plan


def test_all_cells_give_the_exact_rows(planted, index):
    vectors, x = planted
    finite = vectors.where("id != 'nan' and id != 'none'")
    for books in (None, ["b1"], ["absent"]):
        q = (-x[7]).tolist()
        want = retrieval.cosine_topk(finite, q, 25, books).collect()
        assert cells.topk(index, q, 25, books, 1.0).collect() == want
        assert set(ids(cells.topk(index, q, ROWS + 4, books, 1.0))) == set(ids(retrieval.of_books(finite, books)))


def test_small_filters_still_give_k(planted, index):
    few = cells.topk(index, planted[1][3].tolist(), 300, ["b9"], share=0.01)
    assert few.count() == 300


def test_vectors_are_added_and_books_dropped(spark, planted, tmp_path):
    vectors, x = planted
    index = cells.build(vectors.where("book_id is null or book_id != 'b5'"), f"file://{tmp_path}/index", cells=9)
    q = x[5].tolist()
    cells.add(index, vectors.where("book_id = 'b5'"))
    assert ids(cells.topk(index, q, 10, share=1.0)) == ids(retrieval.cosine_topk(vectors.where("id not in ('nan', 'none')"), q, 10))
    cells.drop_books(index, ["b5", "b1"])
    left = vectors.where("book_id is null or book_id not in ('b1', 'b5')")
    assert sorted(ids(index.vectors)) == sorted(ids(left)) and index.counts.agg(F.sum("n")).first()[0] == left.count()


def test_tables_without_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, book_id string, vector array<double>")
    assert cells.topk(cells.build(empty, f"file://{tmp_path}/a"), [1.0, 0.0]).count() == 0
    one = spark.createDataFrame([("a", "b", [0.0, 0.0])], empty.schema)
    assert ids(cells.topk(cells.build(one, f"file://{tmp_path}/b"), [1.0, 0.0])) == ["a"]
    two = spark.createDataFrame([("a", "b", [1.0, 0.0])], empty.schema)
    assert ids(cells.topk(cells.build(two, f"file://{tmp_path}/c"), [1.0, 0.0])) == ["a"]
