"""Learnt dictionaries, best paths, and their use by search and keywords."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.operators import keywords, lattice, retrieval

CHARACTERS = [chr(0x4E00 + 37 * k) for k in range(200)]


@pytest.fixture(scope="module")
def planted(spark):
    """Words of two or three characters, each a word of its own characters or not, run together without spaces."""
    rng = random.Random(4)
    words = ["".join(rng.sample(CHARACTERS, rng.choice([2, 2, 3]))) for _ in range(40)]
    said = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(400)]
    rows = [(k, "".join(s) + rng.choice(["", "。", " plain text"])) for k, s in enumerate(said)] + [(900, None), (901, ""), (902, "no such characters")]
    return spark.createDataFrame(rows, "id int, text string"), words, said


def test_planted_words_are_found(planted):
    texts, words, _ = planted
    found = {r["word"] for r in lattice.learn(texts).collect()}
    assert len(found & set(words)) >= 0.95 * len(set(words)) and len(found - set(words)) <= 0.1 * len(found)


def test_figures_equal_a_plain_count(spark):
    rng = random.Random(1)
    runs = ["".join(rng.choices(CHARACTERS[:6], k=rng.randint(1, 9))) for _ in range(60)]
    got = {r["word"]: r for r in lattice.learn(spark.createDataFrame([(r,) for r in runs], "text string"), "text", 3, 2, -9.0, 0.0).collect()}
    n, sides = Counter(), [defaultdict(Counter), defaultdict(Counter)]
    for r, i, k in ((r, i, k) for r in runs for i in range(len(r)) for k in (1, 2, 3) if i + k <= len(r)):
        n[r[i : i + k]] += 1
        sides[0][r[i : i + k]][r[i - 1] if i else ""] += 1
        sides[1][r[i : i + k]][r[i + k] if i + k < len(r) else ""] += 1
    size = sum(map(len, runs))
    assert set(got) == {w for w, c in n.items() if len(w) > 1 and c >= 2}
    for w, row in got.items():
        assert row["n"] == n[w]
        assert row["cohesion"] == pytest.approx(min(math.log(n[w] * size / (n[w[:i]] * n[w[i:]])) for i in range(1, len(w))))
        parts = [[c for x, c in s[w].items() if x] + [1] * s[w][""] for s in sides]
        assert row["freedom"] == pytest.approx(min(-sum(c / n[w] * math.log(c / n[w]) for c in p) for p in parts))


def test_the_best_path_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(60):
        run = "".join(rng.choices("甲乙丙", k=rng.randint(1, 7)))
        cost = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 3))): rng.uniform(0, 5) for _ in range(9)}
        cuts = (c for r in range(len(run)) for c in itertools.combinations(range(1, len(run)), r))
        parts = ([run[a:b] for a, b in zip((0, *c), (*c, len(run)))] for c in cuts)
        totals = [sum(cost.get(p, 6.0 if len(p) == 1 else math.inf) for p in ps) for ps in parts]
        path = lattice.best_path(run, cost, 3, 6.0)
        assert "".join(path) == run and sum(cost.get(p, 6.0) for p in path) == pytest.approx(min(totals))


def test_search_and_keywords_use_the_words(spark, planted):
    texts, words, said = planted
    cut = lattice.tokenizer(lattice.learn(texts))
    got = {r["id"]: r["w"] for r in texts.select("id", cut(F.col("text")).alias("w")).collect()}
    right = sum((Counter(got[k]) & Counter(s)).total() for k, s in enumerate(said))
    assert right >= 0.9 * sum(map(len, said))
    assert got[900] == got[901] == [] and got[902] == ["no", "such", "characters"]
    mixed = spark.createDataFrame([(f"{words[0]}Abc9{words[1]} été",)], "text string").select(cut(F.col("text"))).first()[0]
    assert mixed == [words[0], "abc9", words[1], "été"]
    chunks = texts.select(F.col("id").cast("string").alias("id"), F.col("text").alias("content"))
    asked = said[7][0]
    hits = {r["id"] for r in retrieval.bm25_scores(chunks, asked, cut).collect()}
    assert hits == {str(k) for k, w in got.items() if asked in w}
    top = keywords.term_topk(texts.where("id < 20"), ["id"], 3, cut).collect()
    assert top and all(r["term"] in got[r["id"]] for r in top)


def test_long_runs_are_counted_in_stretches(spark, monkeypatch):
    """A run is counted in linear time, also across the stretches that a task holds."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("".join(CHARACTERS[:5]) + "。x", [9] * 5 + [1, 1], k=k)) for k in (0, 1, 300, 3, 40)]
    want = Counter()
    for run in (r for t in texts for r in "".join(c if c in CHARACTERS else " " for c in t).split()):
        for i, k in ((i, k) for i in range(len(run)) for k in (1, 2, 3) if i + k <= len(run)):
            want[run[i : i + k], 0, run[i - 1] if i else ""] += 1
            want[run[i : i + k], 1, run[i + k : i + k + 1]] += 1
    for span in (7, 64, 1 << 21):
        monkeypatch.setattr(lattice, "SPAN", span)
        batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], names=["text"])
        got = Counter()
        for points in lattice._stretches(iter([batch, batch.slice(0, 0)]), 3):
            for part in lattice._counted(points, 3):
                for row in part.to_pylist():
                    got[row["gram"], row["side"], row["neighbour"]] += row["n"]
        assert got == want
    long = spark.createDataFrame([("".join(rng.choices(CHARACTERS[:9], k=1_000_000)),)], "text string")
    assert lattice.learn(long, longest=2, cohesion=-9.0, freedom=0.0).agg(F.sum("n")).first()[0] == 999_999
