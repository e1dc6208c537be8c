"""Operators over words (resampling, decontamination, collocations) against plain computations and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import collocations, contamination, resample
from foliant.llm import queries as registered
from foliant.llm.words import PLAIN, runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "The cat sat, on the mat. THE CAT sat on the mat", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "tie tie tie tie", "en"),
    (4, "tie tie tie tie", "en"),
    (None, "no identifier here but twenty words " * 4, "de"),
    (7, "x", None),
    (8, "word " * 30_000, "es"),
    (9, "ßtraße 漢字 🎉 a b \x00 Éa-é9\tz", "de"),
    (10, " \t\n..,", "de"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 0) for i, t, la in rows], DOCS).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def random_docs(n, seed, vocabulary=40, most=120):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abÉ漢9") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [(k, "".join(rng.choice(names) + rng.choice([" ", " ", "  ", ", ", ".\n", "-"]) for _ in range(rng.randint(0, most))), rng.choice(["en", "de"])) for k in range(n)]


def test_runs_are_the_words_of_each_text():
    texts = [t or "" for _, t, _ in ODD] + ["a", "b", "", "c d", " e"]
    coded, cuts, _ = runs(pa.array(texts), PLAIN)
    words = coded.dictionary_decode().to_pylist()
    assert [words[a:b] for a, b in zip(cuts[:-1], cuts[1:])] == [plain_words(t) for t in texts]
    coded, cuts, _ = runs(pa.array(texts).slice(2, 5), PLAIN)
    assert np.diff(cuts).tolist() == [len(plain_words(t)) for t in texts[2:7]]
    assert len(runs(pa.array([], pa.string()), PLAIN)[0]) == 0


# 11 --------------------------------------------------------------------------------------------


def plain_resample(rows, target, longest, buckets, seed, percent, least):
    def grams(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [grams(t) for _, t, _ in rows]
    s, t = Counter(b for g in own for b in g), Counter(b for x in target for b in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, text, _), g in zip(rows, own):
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(plain_words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, buckets, percent, least", [(1, 10_000, 10, 20), (2, 50, 35, 3), (3, 7, 100, 0)])
def test_resampling_equals_a_plain_computation(spark, longest, buckets, percent, least):
    rows = [*random_docs(150, 5), *((None if i is None else i + 1000, t, la) for i, t, la in ODD)]
    target = [None, "", "漢a the cat sat", "É9 É9 É9 on the mat 漢", *(t for _, t, _ in random_docs(5, 6))]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = resample.resample(docs_of(spark, rows), items, longest, buckets, 7, percent, least)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, longest, buckets, 7, percent, least)


def test_resampling_takes_empty_tables_and_clashing_names(spark):
    docs = docs_of(spark, ODD)
    items = spark.createDataFrame([(1, "the cat")], "item_id int, text string")
    for name in ("bucket", "block", "at", "n", "ids", "gain", "score", "weight", "rank", "uid"):
        docs, items = docs.withColumn(name, F.lit(3)), items.withColumn(name, F.lit("x"))
    assert resample.resample(docs, items).count() == len(ODD)
    assert resample.resample(docs.limit(0), items).count() == 0
    nothing = {r["doc_id"]: r["weight"] for r in resample.resample(docs, items.limit(0)).collect()}
    assert nothing[2] == 0 and nothing[8] < nothing[7]


# 12 --------------------------------------------------------------------------------------------


def plain_contaminated(rows, items, size):
    out = []
    phrases = defaultdict(set)
    for i, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            phrases[tuple(w[k : k + size])].add("" if i is None else str(i))
    for i, text, _ in rows:
        w = plain_words(text)
        hit, found = set(), set()
        for p, own in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 10])
def test_decontamination_equals_a_plain_search(spark, size):
    rng = random.Random(size)
    rows = [*random_docs(80, 1, 12), *((None if i is None else i + 1000, t, la) for i, t, la in ODD)]
    items = [(None, "tie tie"), (1, None), (2, ""), (3, "the mat the"), (3, "x"), (10, "cat sat on the"), (11, "never said in any text"), (12, "漢字 🎉")]
    for k in range(20, 50):  # passages of the documents, some of which overlap or occur several times
        w = plain_words(rows[rng.randrange(80)][1])
        a = rng.randrange(max(1, len(w)))
        items.append((k % 40, " - ".join(w[a : a + rng.randint(1, 2 * size)]).upper()))
    items.append((99, "word " * 50))
    frame = spark.createDataFrame(items, "item_id int, text string").withColumn("term", F.lit(1)).withColumn("block", F.lit(1)).withColumn("lang", F.lit(2))
    docs = docs_of(spark, rows).withColumn("uid", F.lit(1)).withColumn("item_id", F.lit(1)).withColumn("phrase", F.lit(1))
    got = sorted(map(tuple, contamination.contaminated(docs, frame, size).collect()), key=str)
    want = plain_contaminated(rows, items, size)
    assert got == want and sum(r[5] for r in want) > 20
    assert contamination.contaminated(docs.limit(0), frame).count() == 0
    assert {r["n_hit"] for r in contamination.contaminated(docs, frame.limit(0)).collect()} == {0}


@pytest.mark.parametrize("within", [2, 4, 9])
def test_proximity_matches_equal_a_plain_search(spark, within):
    rows = random_docs(40, within, 9, 60)
    index = contamination.build(docs_of(spark, rows).select("doc_id", "text"))
    words = sorted({w for _, t, _ in rows for w in plain_words(t)})
    rng = random.Random(within)
    asked = [(k, rng.sample(words, rng.randint(1, 3))) for k in range(12)] + [(50, [words[0], words[0]]), (51, [words[0], "absent"])]
    frame = spark.createDataFrame(asked, "phrase int, words array<string>")
    got = contamination.occurrences(index, frame, within).join(contamination.documents(index), "uid").select("doc_id", "phrase", "first", "last")
    want = set()
    for i, text, _ in rows:
        w = plain_words(text)
        for p, need in asked:
            spans = {(a, b) for a in range(len(w)) for b in range(a, min(a + within, len(w))) if set(need) <= set(w[a : b + 1])}
            want |= {(i, p, a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 30
    phrases = contamination.occurrences(index, spark.createDataFrame([(1, plain_words(rows[3][1])[:2])], "phrase int, words array<string>"))
    assert phrases.count() >= 1


# 13 --------------------------------------------------------------------------------------------


def plain_collocations(rows, least, longest, top, covered):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if a >= least}
    out = defaultdict(list)
    for (lang, p), a in good.items():
        if len(p) < 2:
            continue
        longer = [b for (la, q), b in good.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, r, p.decode(), -a, l, right, n[lang], -s) for lang, some in out.items() for r, (s, a, p, l, right) in enumerate(sorted(some)[:top], 1)
    )


@pytest.mark.parametrize("least, longest, top, covered, vocabulary", [(4, 5, 2000, 100, 12), (3, 4, 20, 60, 5), (2, 2, 7, 100, 40)])
def test_collocations_equal_a_plain_count(spark, least, longest, top, covered, vocabulary):
    rows = [*random_docs(120, least, vocabulary), *ODD[:7], *ODD[8:], (50, "so so so so so so, so so", None), (51, "und " * 9, "und"), (52, "a b c " * 5, "en")]
    docs = docs_of(spark, rows)
    for name in ("kind", "bucket", "block", "key", "id", "own", "phrase"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(map(tuple, collocations.collocations(docs, least, longest, top, covered).collect()))
    assert got == plain_collocations(rows, least, longest, top, covered) and len(got) > 10
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_long_texts_are_cut_where_pieces_end(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    text = ". ".join("left right middle" for _ in range(400)) + " left right middle" * 30
    parts = [p[0].as_py() for p in collocations._parts(pa.array([text]))]
    assert "".join(parts) == text and len(parts) > 5 and all(p.endswith(".") for p in parts[:-1])
    found, n = collocations.phrases(docs_of(spark, [(1, text * 120, "en")]).select("text", "lang"), 100, 3)
    counts = {r["phrase"]: r["f"] for r in found.collect()}
    want = Counter(" ".join(w[i : i + k]) for p in re.split("[.]", text * 120) for w in [p.split()] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert counts == {p: c for p, c in want.items() if c >= 100} and n.first()["n"] == sum(len(p.split()) for p in re.split("[.]", text * 120))


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts near the largest that a corpus could have: products of some 100 bits, exact."""
    a, n = 10**14 + 7, 10**15 + 3
    found = spark.createDataFrame(
        [("en", "x", 1, a, [a]), ("en", "y", 1, a + 1, [a + 1]), ("en", "x y", 2, a - 1, [a, a - 1])], "lang string, phrase string, k int, f long, firsts array<long>"
    )
    monkeypatch.setattr(collocations, "phrases", lambda *_: (found, spark.createDataFrame([("en", n)], "lang string, n long")))
    (row,) = collocations.collocations(docs_of(spark, [])).collect()
    assert row["score"] == 1000 * (a - 1) * n // (a * (a + 1)) and 1000 * (a - 1) * n > 2**96


# SQL -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_decontamination", "op13_collocations"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registered.queries()[name](spark, SF).select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
