"""Quality by hierarchical empirical Bayes: document evidence, shrunk site and path posteriors."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stash, with_field
from foliant.llm.labelled import labelled_sample

TRAIN_ROWS = 8000
#: And so many bytes of text.
TRAIN_BYTES = 128 << 20
THRESHOLD = 0.5
#: How much of a site's log odds against the corpus a document takes over.
SITE_WEIGHT = 0.5
#: Bounds of the documents that a prior counts as.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
#: Buckets of word n-grams.
BUCKETS = 1 << 16


def features(text: str) -> list[float]:
    """Shape of a whole text: kinds of characters, words and lines, each as a share."""
    raw = text.encode("utf-8", "replace")
    n = len(raw) or 1
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words, lines = raw.split(), raw.split(b"\n")
    w = len(words) or 1
    lower, upper, digit = h[97:123].sum(), h[65:91].sum(), h[48:58].sum()
    marks = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    plain = h[44] + h[46] + h[45] + h[39]
    kinds = Counter(words)
    common = max(kinds.values(), default=0) / w
    return [
        lower,
        upper / (lower + upper + 1e-3),
        np.sqrt(digit),
        np.sqrt(max(marks - plain, 0.0)),
        np.sqrt(h[33] + h[63]),
        np.sqrt(h[124]),
        np.sqrt(h[[35, 36, 37, 38, 42]].sum()),
        np.sqrt(max(plain, 0.0)),
        h[128:].sum(),
        n / w / 10,
        len(kinds) / w,
        common,
        len(set(lines)) / len(lines),
        np.sqrt(len(lines) / w),
        np.log1p(n) / 10,
        np.log1p(w) / 10,
    ]


def grams(text: str) -> np.ndarray:
    """Buckets of the distinct words and word pairs of a whole text, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    code = {w: zlib.crc32(w) for w in set(words)}
    one = np.fromiter(map(code.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
    return np.unique(np.r_[one, two] % np.uint64(BUCKETS)).astype(np.int64)


def gram_odds(each: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of quality 1 for each bucket, by the texts that have it; 0 for those that none has."""
    seen = np.zeros((2, BUCKETS))
    for g, label in zip(each, y):
        seen[int(label), g] += 1
    share = (seen[1] + 1) / ((y == 1).sum() + 2), (seen[0] + 1) / ((y == 0).sum() + 2)
    return np.where(seen.sum(axis=0) > 1, np.clip(np.log(share[0]) - np.log(share[1]), -3, 3), 0.0)


def gram_features(g: np.ndarray, odds: np.ndarray) -> list[float]:
    """How the text's n-grams lean: their mean log odds, and the share of those that lean to quality 0."""
    known = odds[g]
    return [float(known.sum() / max(1, len(g))), float((known < -1).sum() / max(1, len(g)))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on standardised features and their squares, by Newton steps: (weights, scaling)."""
    scale = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-6])
    z = expand(x, scale)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
    return w, scale


def expand(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - scale[0]) / scale[1], -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, z * z / 4])


@dataclass
class Evidence:
    """A classifier of whole texts: shape and word n-grams into a logistic regression."""

    weights: np.ndarray
    scale: np.ndarray
    odds: np.ndarray

    @classmethod
    def learn(cls, shapes: np.ndarray, each: list[np.ndarray], y: np.ndarray) -> Evidence:
        """The regression sees n-gram features by the log odds of the other half of the rows, never its own."""
        half = np.arange(len(y)) % 2
        folds = [gram_odds([g for g, h in zip(each, half) if h == side], y[half == side]) for side in (1, 0)]
        leaning = np.array([gram_features(g, folds[h]) for g, h in zip(each, half)])
        weights, scale = fit(np.hstack([shapes, leaning]), y)
        return cls(weights, scale, gram_odds(each, y))

    def probability(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t) + gram_features(grams(t), self.odds) for t in texts])
        return 1 / (1 + np.exp(-np.clip(expand(x, self.scale) @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Evidence | None:
    """The classifier of at most ``rows`` labelled rows and TRAIN_BYTES of text; None without labels of both kinds.

    The tasks reduce each text to its shape and n-gram buckets; one task learns from these, and
    the driver gets the model alone.
    """

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            g = pa.array([grams(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x, g, batch.column("label")], names=["doc_id", "x", "g", "label"])

    sample = labelled_sample(docs, labels, "quality", rows, most_bytes=TRAIN_BYTES)
    kind = sample.schema["doc_id"].dataType.simpleString()
    shapes = sample.mapInArrow(shape, f"doc_id {kind}, x array<double>, g array<int>, label int")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held).sort_by("doc_id")
        y = own.column("label").to_numpy()
        if len(set(y.tolist())) == 2:
            each = [g for c in own.column("g").chunks for g in np.split(c.flatten().to_numpy(), c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py())]
            model = Evidence.learn(np.array(own.column("x").to_pylist()), each, y)
            yield pa.RecordBatch.from_pylist([{k: np.asarray(v, float).tobytes() for k, v in vars(model).items()}])

    got = shapes.repartition(1).mapInArrow(learn, "weights binary, scale binary, odds binary").collect()
    if not got:
        return None
    weights, scale, odds = (np.frombuffer(x) for x in got[0])
    return Evidence(weights, scale.reshape(2, -1), odds)


def evidence(docs: DataFrame, model: Evidence | None, into: str = "evidence") -> DataFrame:
    """``docs`` plus the probability of quality 1 from the whole text; 1/2 without a model."""
    at = docs.schema.fieldNames().index("text")
    out = with_field(docs.schema, into, "double")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            for k in range(0, batch.num_rows if shipped.value else 0, 256):  # few texts at a time are Python strings
                p[k : k + 256] = shipped.value.probability([t or "" for t in batch.column(at).slice(k, 256).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=out.names)

    return docs.mapInArrow(run, out)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, within: float) -> float:
    """Documents that the prior of groups (n, total) counts as, in parents (parent_n, parent_total): within / between.

    ``within`` is the variance of evidence inside of groups, between that of the groups' true
    means around their parent's, by moments: the spread seen in a parent of k groups is
    (k - 1) * within + between * (N - sum of n^2 / N). So a host's paths count by how far they
    lie from each other, not by how far the host lies from the corpus.
    """
    mean = F.col("parent_total") / F.col("parent_n")
    share = F.col("total") / F.col("n")
    got = groups.agg(
        F.sum(F.col("n") * (share - mean) * (share - mean)).alias("spread"),
        F.sum(1 - F.col("n") / F.col("parent_n")).alias("noise"),
        F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("parent_n")).alias("room"),
    ).first()
    if not got["room"]:
        return MOST_STRENGTH
    between = (got["spread"] - within * got["noise"]) / got["room"]
    return float(np.clip(within / between, LEAST_STRENGTH, MOST_STRENGTH)) if between > 0 else MOST_STRENGTH


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    threshold: float = THRESHOLD,
    rows: int = TRAIN_ROWS,
    keep_row: bool = False,
) -> DataFrame:
    """Posterior quality of every document from its own evidence and that of its site.

    Returns per row: doc_id, host, path, evidence, host_posterior, path_posterior, score,
    kept (score >= threshold) and, with ``keep_row``, the input row as struct ``record``.

    A host's posterior is its documents' mean evidence shrunk to the corpus mean, a path's is
    shrunk to its host's; how strongly follows from how far the groups' means lie apart, hosts
    in the corpus and paths in their host. So a host with few documents is close to the corpus.
    A document's score adds the posterior of its path without the document itself to its own
    evidence, which so counts once. Sums are grouped before any shuffle, so a host with a third
    of all rows is one row for each task. By default the host is the column
    source and the path is lang within it; null is a host or path of its own. Null and empty
    texts have evidence as such; without labels of both kinds all evidence is 1/2. Repeated
    rows count each.
    """
    host = docs["source"].cast("string") if host is None else host
    path = docs["lang"].cast("string") if path is None else path
    none = F.lit("\0null")
    own = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.coalesce(host, none).alias("host"),
        F.coalesce(path, none).alias("path"),
        docs["text"].alias("text"),
        *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("record")] if keep_row else []),
    )
    model = train(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), labels, rows)
    scored = stash(evidence(own, model).drop("text"), "evidence")
    square = F.sum(F.col("evidence") * F.col("evidence"))
    sums = (F.count("*").alias("n"), F.sum("evidence").alias("total"), square.alias("squares"))
    paths = stash(scored.groupBy("host", "path").agg(*sums), "paths")
    add = [F.sum(c).alias(c) for c in ("n", "total", "squares")]
    hosts = paths.groupBy("host").agg(*add)
    whole = hosts.agg(*add).first()
    n, total = whole["n"] or 0, whole["total"] or 0.0
    mean = float(np.clip(total / n, 1e-3, 1 - 1e-3)) if n else 0.5
    inside = paths.agg(F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("s"), F.count("*").alias("k")).first()
    within = max((inside["s"] or 0.0) / max(1, n - inside["k"]), 1e-6)
    in_host = paths.join(hosts.select("host", F.col("n").alias("parent_n"), F.col("total").alias("parent_total")), "host")
    k_host = _strength(hosts.withColumn("parent_n", F.lit(max(n, 1))).withColumn("parent_total", F.lit(total)), within)
    k_path = _strength(in_host, within)
    sites = stash(in_host.select("host", "path", "n", "total", "parent_n", "parent_total"), "sites")

    def posteriors(own: Column, seen: Column) -> tuple[Column, Column]:
        """Of host and path, without ``seen`` documents of evidence ``own``."""
        of_host = (k_host * F.lit(mean) + F.col("parent_total") - own) / (k_host + F.col("parent_n") - seen)
        return of_host, (k_path * of_host + F.col("total") - own) / (k_path + F.col("n") - seen)

    out = scored.join(sites, ["host", "path"])
    of_host, of_path = posteriors(F.lit(0.0), F.lit(0))
    _, of_others = posteriors(F.col("evidence"), F.lit(1))
    odds = _logit(F.col("evidence")) + SITE_WEIGHT * (_logit(of_others) - _logit(F.lit(mean)))
    out = out.withColumns({"host_posterior": of_host, "path_posterior": of_path, "score": 1 / (1 + F.exp(-odds))})
    shown = [F.when(F.col(c) != none, F.col(c)).alias(c) for c in ("host", "path")]
    return out.select(
        "doc_id",
        *shown,
        "evidence",
        "host_posterior",
        "path_posterior",
        "score",
        (F.col("score") >= threshold).alias("kept"),
        *(["record"] if keep_row else []),
    )
