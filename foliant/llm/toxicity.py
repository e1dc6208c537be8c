"""Toxicity by bags of subword embeddings: character n-grams share vectors, so misspellings do too."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import crc_remainder, pick, with_field
from foliant.llm.groups import by_bucket, sorted_by_bucket
from foliant.llm.labelled import labelled_sample
from foliant.llm.words import batched, gather, split

BUCKETS = 1 << 17
DIMENSIONS = 8
SIZES = (3, 4, 5, 6)
#: Words of a bag; one begins at every word. A document is as toxic as its most toxic bag, so long texts don't dilute one.
BAG = 8
#: The training sample: at most so many labelled rows, and so many bytes of text.
TRAIN_ROWS, TRAIN_BYTES = 8000, 64 << 20
#: Words whose bags are compared at a time.
BLOCK_WORDS = 1 << 20
#: The threshold is set by the scores of rows from models that were fitted without them, of so many folds.
FOLDS = 4
#: Of the clean rows at most this share may be above the threshold; with few toxic rows the cut shrinks to even odds, as if from so many.
CLEAN_SHARE, PRIOR_ROWS = 0.02, 20
#: An n-gram's first weight is its log odds after so many texts without evidence.
PRIOR_TEXTS = 10.0
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' character n-grams, number for each word); a word is marked <word>."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    marked = ["<" + w + ">" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    del marked
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))).astype(np.int32)  # characters to the word's end
    per_word = np.stack([np.maximum(sizes - n + 1, 0) for n in SIZES], axis=1)
    counts = per_word.sum(axis=1)
    starts = (np.cumsum(counts)[:, None] - counts[:, None] + np.cumsum(per_word, axis=1) - per_word).T
    out = np.empty(int(counts.sum()), np.int32)
    for k, n in enumerate(SIZES):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), 1469598103934665603 + n, np.uint64)
        for j in range(n):
            h = (h ^ chars[at + j]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        ends = np.cumsum(per_word[:, k])
        place = np.repeat(starts[k] - (ends - per_word[:, k]), per_word[:, k]) + np.arange(len(at))
        out[place] = h % np.uint64(BUCKETS)
    return out, counts


@dataclass
class SubwordModel:
    """Embeddings of n-gram buckets and the two rows of a linear softmax over their average."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """What each word adds to the difference of the two logits, times the bag's size."""
        grams, counts = subwords(words)
        per_gram = (self.embeddings @ (self.softmax[1] - self.softmax[0]))[grams]
        # bin by bin, so a word's sum doesn't depend on the words around
        sums = np.bincount(np.repeat(np.arange(len(counts)), counts), per_gram, len(counts))
        return sums / np.maximum(counts, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of the toxic label for each whole text."""
        chunks, codes, offsets = split(texts)
        per_chunk = [_WORD.findall(c.lower()) for c in chunks]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(w for ws in per_chunk for w in ws))}
        each = self.word_scores(list(numbers))
        sizes = np.fromiter(map(len, per_chunk), np.int64, len(per_chunk))
        flat = np.fromiter((numbers[w] for ws in per_chunk for w in ws), np.int64, int(sizes.sum()))
        flat, ends = gather(flat, np.cumsum(sizes) - sizes, sizes, codes)
        cuts = np.r_[0, ends][offsets]
        return 1 / (1 + np.exp(-self.bags(each, flat, cuts)[0]))

    def bags(self, each: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``top_bags`` of texts whose words are numbers ``flat`` with scores ``each``, some texts of BLOCK_WORDS words or one longer at a time."""
        tops, firsts = [np.zeros(0)], [np.zeros(0, cuts.dtype)]
        a = 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + BLOCK_WORDS, side="right")) - 1)
            top, first = self.top_bags(each[flat[cuts[a] : cuts[b]]], cuts[a : b + 1] - cuts[a])
            tops.append(top)
            firsts.append(first + cuts[a])
            a = b
        return np.concatenate(tops), np.concatenate(firsts)

    def top_bags(self, z: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit, first word) of the most toxic bag of each text whose words' scores are z[cuts[i]:cuts[i+1]]."""
        n = np.diff(cuts)
        owner = np.repeat(np.arange(len(n)), n)
        left = np.repeat(cuts[1:], n) - np.arange(len(z))  # words to the text's end
        logits = np.zeros(len(z))
        for k in range(min(BAG, len(z))):  # word by word, so a bag's sum doesn't depend on the rows around
            logits[: len(z) - k] += np.where(left[: len(z) - k] > k, z[k:], 0.0)
        logits = logits / BAG + self.bias
        top, first = np.full(len(n), self.bias), cuts[:-1].copy()
        full = np.flatnonzero(n)
        if len(full):
            top[full] = np.maximum.reduceat(logits, cuts[:-1][full])
            hit = np.flatnonzero(logits == top[owner])[::-1]
            first[owner[hit]] = hit
        return top, first


def fit(texts: Iterable[str], labels: np.ndarray, epochs: int = 20, rate: float = 0.3, seed: int = 0) -> SubwordModel:
    """Train embeddings and softmax jointly on whole texts and their labels.

    Each epoch takes the most toxic bag of every text by the model so far, and a random bag of
    a quarter of the texts that are not toxic, and makes an Adam step on the expected error of their
    averages, which rows with a wrong label bend less than they bend the logistic loss. The first
    coordinate starts from the log odds of the n-gram among toxic texts, shrunk where it is rare.
    """
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    flat_words, sizes = array("i"), [0]
    for text in texts:
        own = _WORD.findall(text.lower())
        flat_words.extend([numbers.setdefault(w, len(numbers)) for w in own])
        sizes.append(len(own))
    flat = np.frombuffer(flat_words, np.int32) if flat_words else np.zeros(0, np.int32)
    cuts = np.cumsum(sizes)
    grams, counts = subwords(list(numbers))
    del numbers
    gram_ends = np.cumsum(counts)
    good, bad = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    seen = np.zeros((2, BUCKETS))
    for a, b, y in zip(cuts[:-1], cuts[1:], labels):
        own = np.unique(flat[a:b])
        g, _ = gather(grams, gram_ends - counts, counts, own)
        seen[int(y), np.unique(g)] += 1
    share = bad / (bad + good)
    odds = np.log((seen[1] + PRIOR_TEXTS * share) / (seen[0] + PRIOR_TEXTS * (1 - share))) - np.log(share / (1 - share))
    model = SubwordModel(rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (2, DIMENSIONS)), -4.0)
    model.embeddings[:, 0] = np.where(seen.sum(axis=0) > 0, np.clip(odds, -4, 4), 0)
    model.softmax[:, 0] = (-6.0, 6.0)
    weight = np.where(labels == 1, (good / bad) ** 0.5, 1.0)
    steps = [np.zeros_like(model.embeddings), np.zeros_like(model.embeddings), np.zeros((2, 2, DIMENSIONS)), np.zeros(2)]
    n = np.diff(cuts)
    for epoch in range(1, epochs + 1):
        per_gram = (model.embeddings @ (model.softmax[1] - model.softmax[0]))[grams]
        sums = np.r_[0.0, np.cumsum(per_gram)]
        z = (sums[gram_ends] - sums[gram_ends - counts]) / np.maximum(counts, 1)
        _, first = model.bags(z, flat, cuts)
        some = np.flatnonzero((labels == 0) & (n > 0))[epoch % 4 :: 4]
        start = np.r_[first[n > 0], cuts[some] + rng.integers(0, np.maximum(n[some], 1))]
        owner = np.r_[np.flatnonzero(n > 0), some]
        y = labels[owner].astype(float)
        stop = np.minimum(start + BAG, cuts[owner + 1])
        bag_words, ends = gather(flat, start, stop - start, np.arange(len(start)))
        bag = np.repeat(np.arange(len(start)), stop - start)
        g, _ = gather(grams, gram_ends - counts, counts, bag_words)
        share = np.repeat(1 / (BAG * np.maximum(counts[bag_words], 1)), counts[bag_words])
        of = np.repeat(bag, counts[bag_words])
        mean = np.stack([np.bincount(of, share * model.embeddings[g, d], len(start)) for d in range(DIMENSIONS)], axis=1)
        logit = mean @ (model.softmax[1] - model.softmax[0]) + model.bias
        p = 1 / (1 + np.exp(-logit))
        err = (p - y) * np.where(y == 1, p, 1 - p) * weight[owner] / len(owner)
        direction = model.softmax[1] - model.softmax[0]
        per_bucket = np.bincount(g, share * err[of], BUCKETS)
        grads = per_bucket[:, None] * direction + 1e-5 * model.embeddings
        to_softmax = err @ mean
        grad_softmax = np.stack([-to_softmax, to_softmax]) + 1e-4 * model.softmax
        m, v, s, b = steps
        touched = np.flatnonzero(per_bucket)
        m[touched] = 0.9 * m[touched] + 0.1 * grads[touched]
        v[touched] = 0.99 * v[touched] + 0.01 * grads[touched] ** 2
        model.embeddings[touched] -= rate * 0.3 * m[touched] / (np.sqrt(v[touched]) + 1e-8)
        s[0] = 0.9 * s[0] + 0.1 * grad_softmax
        s[1] = 0.99 * s[1] + 0.01 * grad_softmax**2
        model.softmax -= rate * 0.1 * s[0] / (np.sqrt(s[1]) + 1e-8)
        b[0] = 0.9 * b[0] + 0.1 * err.sum()
        b[1] = 0.99 * b[1] + 0.01 * err.sum() ** 2
        model.bias -= rate * 0.1 * b[0] / (np.sqrt(b[1]) + 1e-8)
    return model


def logits(model: SubwordModel, texts: list[str]) -> np.ndarray:
    p = np.clip(model.scores(pa.array(texts, pa.string())), 1e-15, 1 - 1e-15)
    return np.log(p) - np.log1p(-p)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = FOLDS) -> SubwordModel:
    """The model of at most ``rows`` rows (and TRAIN_BYTES of text) whose crc32 remainder is not the held-out one.

    All rows train it. Its threshold comes from ``folds`` more models, each fitted without the rows
    that it then scores. Each model is one task over that bounded sample; the driver gets the
    arrays and the scores alone.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, held_out=(3, 1), most_bytes=TRAIN_BYTES)
    sample = sample.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(folds)).cast("int"))
    sample = sample.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(folds))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, 1):
            fold, order = table.column("bucket")[0].as_py(), pc.sort_indices(table.column("doc_id")).to_numpy()
            texts = table.column("text")  # read one by one: no second copy of the sample
            y = table.column("label").to_numpy()[order]
            out = table.column("own").to_numpy()[order] == fold
            model = fit((texts[k].as_py() for k in order[~out].tolist()), y[~out])
            others = order[out].tolist()
            z = [logits(model, [texts[k].as_py() for k in others[a : a + 256]]) for a in range(0, len(others), 256)]
            said = {"labels": y[out].tolist(), "logits": np.concatenate([np.zeros(0), *z]).tolist()}
            if fold == folds:
                said = {"embeddings": model.embeddings.astype(np.float32).tobytes(), "softmax": model.softmax.tobytes(), "bias": float(model.bias)}
            yield pa.RecordBatch.from_arrays([pa.array([said.get(f.name)], f.type) for f in schema], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "labels array<int>, logits array<double>, embeddings binary, softmax binary, bias double"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    got = sorted_by_bucket(sample).mapInArrow(run, ddl).collect()
    whole = next((r for r in got if r["embeddings"] is not None), None)
    if whole is None:
        return SubwordModel(np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros((2, DIMENSIONS)), -4.0)
    embeddings = np.frombuffer(whole["embeddings"], np.float32).reshape(BUCKETS, DIMENSIONS)
    model = SubwordModel(embeddings, np.frombuffer(whole["softmax"]).reshape(2, DIMENSIONS), whole["bias"])
    z, y = (np.array([x for r in got for x in r[c] or ()]) for c in ("logits", "labels"))
    return shifted(model, best_cut(z, y))


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The logit that separates these rows best by F0.5 (precision counts more), halfway in its gap.

    Only cuts with at most CLEAN_SHARE of the clean rows above them count. The cut shrinks to
    even odds, 0, as far as there are few toxic rows to set it by.
    """
    order = np.lexsort((labels, -z))
    z, toxic = z[order], labels[order] == 1
    hits, taken = np.cumsum(toxic), np.arange(1, len(z) + 1)
    n = int(hits[-1]) if len(z) else 0
    if not n or n == len(z):
        return 0.0
    fitness = np.where(taken - hits <= CLEAN_SHARE * (len(z) - n), 1.25 * hits / (taken + 0.25 * n), -1.0)
    best = int(np.argmax(fitness))
    if fitness[best] <= 0:
        return max(0.0, float(z[0]))
    below = z[best + 1] if best + 1 < len(z) else z[best] - 1
    return float(n * (z[best] + below) / 2 / (n + PRIOR_ROWS))


def shifted(model: SubwordModel, cut: float, at: float = THRESHOLD) -> SubwordModel:
    """The model whose score is ``at`` where the logit is ``cut``."""
    return SubwordModel(model.embeddings, model.softmax, model.bias + np.log(at / (1 - at)) - cut)


def calibrate(model: SubwordModel, texts: pa.Array, labels: np.ndarray, at: float = THRESHOLD) -> SubwordModel:
    """Shift the bias so that score ``at`` is the best cut of these texts; without both labels it stays."""
    if not (labels == 1).any() or not (labels == 0).any():
        return model
    return shifted(model, best_cut(logits(model, texts.to_pylist()), labels), at)


def score(docs: DataFrame, model: SubwordModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` plus the score, from the whole text alone. ``into`` must not be a column yet."""
    schema = docs.schema
    out = with_field(schema, into, "double")
    at = schema.fieldNames().index(text)
    small = SubwordModel(model.embeddings.astype(np.float32), model.softmax, model.bias)
    shipped = docs.sparkSession.sparkContext.broadcast(small)  # BUCKETS x DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.RecordBatch
        for batch in batched((own.from_arrays(b.columns, names=[f"c{i}" for i in range(b.num_columns)]) for b in batches), f"c{at}"):
            scores = shipped.value.scores(batch.column(at))
            yield own.from_arrays([*batch.columns, pa.array(scores)], names=out.names)

    return docs.mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    held_out: crc32(doc_id as text) mod 3 is 1, such rows' labels are never read; false for a
    null id. score: 0 to 1, from the whole text only. predicted: 1 if score >= threshold.
    Null and empty texts score as a text without words. Repeated rows score the same; other
    columns are not read. Without labels all texts score alike, below the threshold.
    """
    model = train(docs, labels, rows)
    scored = score(pick(docs, doc_id="doc_id", text="text"), model).drop("text")
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
