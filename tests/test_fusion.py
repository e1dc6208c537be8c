"""The threshold algorithm gives the rows of the full fusion, ties and thresholds included."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import retrieval

SCORES = "id string, score double"


def signals(spark, seed, n=200):
    rng = random.Random(seed)
    ids = [f"c{k:03}" for k in range(n)]
    corpus = spark.createDataFrame([(i, f"b{k % 5}", "text") for k, i in enumerate(ids)], "id string, book_id string, content string")
    some = rng.sample(ids, 3 * n // 4) + [f"gone{k}" for k in range(20)]  # vectors of records that are no more
    vector = spark.createDataFrame([(i, rng.choice([1.0, 0.5, 0.25, 0.0, -0.5, rng.uniform(-1, 1)])) for i in some], SCORES)
    keyword = spark.createDataFrame([(i, rng.choice([1.0, 0.5, rng.random(), -0.1])) for i in rng.sample(ids, n // 3)], SCORES)
    return corpus, vector, keyword


@pytest.mark.parametrize("seed, k, threshold", [(1, 10, 0.0), (2, 1, 0.0), (3, 50, 0.3), (4, 300, -1.0), (5, 7, 0.9), (6, 10, -2.0)])
def test_the_rows_of_the_full_fusion(spark, seed, k, threshold):
    corpus, vector, keyword = signals(spark, seed)
    for v, w in ((vector, keyword), (None, keyword), (vector, keyword.limit(0)), (vector.limit(0), keyword), (vector.where("id like 'gone%'"), keyword)):
        want = retrieval.fuse(corpus, v, w, k, threshold).collect()
        got = retrieval.best_fused(corpus, v, w, k, threshold)
        assert got.columns == retrieval.fuse(corpus, v, w, k, threshold).columns and got.collect() == want


def test_no_id_of_the_corpus_is_shuffled(spark, monkeypatch):
    corpus, vector, keyword = signals(spark, 9)
    monkeypatch.setattr(retrieval, "fuse", None)  # it is not needed here
    plan = retrieval.best_fused(corpus, vector, keyword, 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_odd_scores_are_left_to_the_full_fusion(spark):
    corpus, vector, keyword = signals(spark, 4)
    odd = vector.unionByName(spark.createDataFrame([("c001", float("nan"))], SCORES)).where("id != 'c001' or isnan(score)")
    assert [r["id"] for r in retrieval.best_fused(corpus, odd, keyword, 5).collect()] == [r["id"] for r in retrieval.fuse(corpus, odd, keyword, 5).collect()]
    assert retrieval.best_fused(corpus.limit(0), vector, keyword).count() == 0
    assert retrieval.best_fused(corpus.select("id"), vector, keyword, 3).select(F.count("*")).first()[0] == 3
