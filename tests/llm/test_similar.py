"""Near-duplicates by exact similarity: forests of links, exact shares, and whole results against all pairs."""

import random

import numpy as np
import pytest

from foliant.llm import simhash
from foliant.llm.groups import Forests, roots


def sets_of(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def share(a, b, k=5):
    one, other = sets_of(a, k), sets_of(b, k)
    return len(one & other) / len(one | other) if one | other else 1.0


@pytest.mark.parametrize("shingle", [1, 4, 5])
def test_same_share_is_that_of_the_sets(shingle):
    rnd = random.Random(shingle)
    texts = [" ".join(rnd.choices("abcd", k=rnd.choice((0, 1, 3, 4, 5, 9, 40)))) for _ in range(60)]
    for a in texts[:20]:
        for b in [a, a + " d", *texts]:
            assert simhash.same_share(a, b, shingle) == share(a, b, shingle)
    assert simhash.same_share(None, "", 5) == 1.0 and simhash.same_share("", "x", 5) == 0.0
    assert simhash.same_share("A b\tc", "a  B c", 5) == 1.0
    long = " ".join(map(str, range(200_000)))
    assert simhash.same_share(long, long + " end", 5) == 199_996 / 199_997


def plain_forest(n, links):
    label, out = list(range(n)), []
    for d, i, j in sorted(links):
        if label[i] != label[j]:
            out.append((d, i, j))
            old = label[j]
            label = [label[i] if x == old else x for x in label]
    return out


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_forests_are_minimum_spanning_forests(most):
    rng = np.random.default_rng(most)
    for n in (2, 7, 40):
        ends = rng.integers(0, n, (2, 6 * n))
        ends = np.sort(ends[:, ends[0] != ends[1]], axis=0)
        weight = {(int(i), int(j)): int(rng.integers(0, 5)) for i, j in ends.T}
        found = Forests(2, most)
        for k in range(0, ends.shape[1], 3):
            i, j = ends[:, k : k + 3]
            found.add(i, j, np.array([weight[a, b] for a, b in zip(i.tolist(), j.tolist())]))
        got = sorted(zip(*(x.tolist() for x in found.settle())))
        links = {(d, i, j) for (i, j), d in weight.items()}
        first = plain_forest(n, links)
        second = plain_forest(n, links - set(first))
        assert got == sorted((i, j) for _, i, j in first + second)
    i, j = Forests(3).settle()
    assert len(i) == len(j) == 0 and roots(1, i, j).tolist() == [0]


@pytest.mark.parametrize("many", [1, 256])
def test_no_text_goes_without_a_similar_one(spark, monkeypatch, many):
    """Families of edited texts around 0.8, repeated lines and short texts; every component is one of exact links."""
    monkeypatch.setattr(simhash, "MANY", many)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    texts = [None, "", "  ", "one two", "One  two", "one three"]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice((30, 120, 400)))]
        for edits in (0, 0, 1, 2, 4, 7, 10):
            copy = list(base)
            for _ in range(edits * len(base) // 100):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    lines = "the same line of this notice again and again " * 60  # most words repeat, the sets of shingles differ
    texts += [lines + " ".join(word() for _ in range(80)) for _ in range(4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame, shingle=5, similarity=0.8, leaf=16).collect()}
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i) if share(texts[i], texts[j]) >= 0.8]
    label = roots(n, *np.array(near).T).tolist()
    groups = {}
    for i in range(n):
        groups.setdefault(got[i]["component_id"], []).append(i)
    for least, members in groups.items():
        assert least == min(members) and len({label[i] for i in members}) == 1  # nothing is joined that no link joins
        assert [i for i in members if got[i]["kept"]] == [least]
    joined = sum(got[i]["component_id"] == got[j]["component_id"] for i, j in near)
    assert joined >= 0.97 * len(near)
    assert len({got[n - k]["component_id"] for k in (1, 2, 3, 4)}) == 4


def at_the_limit(rnd, n, word):
    """Pairs of n texts whose similarity is 0.8 or a little more, by edits at places far apart."""
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice((60, 150, 304)))]
        copy = list(base)
        for at in range(2, len(base), 5):
            copy[at] = word()
            if share(" ".join(base), " ".join(copy)) < 0.8:
                copy[at] = base[at]
                break
        texts += [" ".join(base), " ".join(copy)]
    return texts


def test_no_link_is_lost(spark):
    """Pairs at just the limit, below it, chains, and a notice that all have; components are those of all pairs."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    texts = at_the_limit(rnd, 100, word)
    notice = " ".join(word() for _ in range(40))
    texts += [f"{notice} {' '.join(word() for _ in range(rnd.choice((3, 9, 30))))}" for _ in range(90)]
    chain = [word() for _ in range(200)]
    for _ in range(30):
        chain = list(chain)
        for _ in range(4):
            chain[rnd.randrange(200)] = word()
        texts.append(" ".join(chain))
    texts += [None, "", "one two", "One  two", "one three"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, shingle=5, similarity=0.8, leaf=16).collect()}
    n, sets = len(texts), [sets_of(t) for t in texts]
    near = [(i, j) for i in range(n) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert [got[i] for i in range(n)] == roots(n, *np.array(near).T).tolist()


@pytest.mark.parametrize("shard", [8, 1 << 16])
def test_open_pairs_are_all_that_join_components(spark, monkeypatch, shard):
    """Nothing linked yet, and a long list dealt to more tasks: every pair at the limit is there, of one component none is."""
    from foliant.llm import shingles

    monkeypatch.setattr(shingles, "SHARD", shard)
    rnd = random.Random(shard)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if rnd.random() > 0.02 else "x" + str(rnd.random()) for w in base) for _ in range(90)]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    linked = spark.createDataFrame([(k, 0) for k in range(0, 90, 2)], "node long, component long")
    got = {tuple(r) for r in shingles.open_pairs(frame, linked, 5, 0.8).collect()}
    near = {(i, j) for j in range(90) for i in range(j) if share(texts[i], texts[j]) >= 0.8}
    apart = lambda i, j: i % 2 or j % 2
    assert {p for p in near if apart(*p)} <= got and all(apart(*p) for p in got) and len(near) > 200


def test_small_tables_are_few_files(spark, monkeypatch):
    """Many shuffle partitions: what is written between the steps is as few files as its rows need."""
    from pathlib import Path

    from foliant.llm import common, components, shingles

    parts = {}

    def stash(df, tag, rows=None):
        out = common.stash(df, tag, rows)
        parts.setdefault(tag, []).append(len(list(Path(out._stash_path.removeprefix("file://")).glob("part-*"))))
        return out

    for module in (components, shingles, simhash):
        monkeypatch.setattr(module, "stash", stash)
    texts = [" ".join(f"w{k}" for k in range(60)) + f" x{n % 12}" * (n % 3) for n in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with common.settings(spark, held):
        got = simhash.near_duplicates(frame, shingle=5, similarity=0.8)
        assert {r["component_id"] for r in got.collect()} == {0}
    small = ("classes", "large", "linked", "sharing", "labels", "members")
    assert {tag: max(parts[tag]) for tag in small} == dict.fromkeys(small, 1)
    assert max(parts["edges"][1:]) <= 24 and parts["edges"].count(1) >= len(parts["edges"]) - 1
    monkeypatch.setattr(common, "FILE_ROWS", 50)
    with common.settings(spark, held):
        assert common.stash(spark.range(120).repartition(24), "ids", 120).rdd.getNumPartitions() <= 3


def test_equal_sets_are_one_class(spark):
    texts = ["a b c d e f", "a b c d e g", "A b c d  e f", "a b c d e f a b c d e f a b c d e", "", None]
    marked = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=5, distinct=True)
    rows = {r["doc_id"]: r for r in marked.collect()}
    assert [rows[k]["size"] for k in range(6)] == [2, 2, 2, 6, 0, 0]
    assert rows[0]["digest"] == rows[2]["digest"] != rows[1]["digest"] and rows[4]["digest"] == rows[5]["digest"]
