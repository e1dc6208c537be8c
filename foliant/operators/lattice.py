"""Words of text without spaces: a dictionary learnt from the corpus, and the best path through each text's word lattice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import HAN

#: Characters of a word at most; its occurrences, its cohesion and the freedom of its edges at least.
LONGEST, LEAST, COHESION, FREEDOM = 4, 5, 2.5, 1.0
#: Words of a dictionary at most, the most frequent ones: what every task holds.
MOST_WORDS = 300_000
#: Characters that a task counts at a time.
SPAN = 1 << 21


def _stretches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[np.ndarray]:
    """Code points of the texts, 0 for all but Han characters and between texts, about ``SPAN`` at a time.

    Each stretch begins with the character before it and ends with the ``longest`` after it.
    """

    def whole(texts: list[str]) -> Iterator[np.ndarray]:
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace"), "<u4")
        han = (points >= 0x4E00) & (points <= 0x9FFF) | (points >= 0x3400) & (points <= 0x4DBF)
        padded = np.zeros(len(points) + 1 + longest, np.uint32)
        padded[1 : len(points) + 1] = points * han
        for at in range(0, len(points), SPAN):
            yield padded[at : min(at + SPAN, len(points)) + 1 + longest]

    held: list[str] = []
    size = 0
    for batch in batches:
        for text in batch.column(0):
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size >= SPAN:
                yield from whole(held)
                held, size = [], 0
    yield from whole(held)


def _numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the place of each key among them, their counts); ``keys`` are below ``most``."""
    if most > 4 * SPAN:
        return np.unique(keys, return_inverse=True, return_counts=True)
    counts = np.bincount(keys, minlength=most)
    found = np.flatnonzero(counts)
    place = np.zeros(most, np.int64)
    place[found] = np.arange(len(found))
    return found, place[keys], counts[found]


def _counted(points: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """(gram, side, neighbour, n) of one stretch."""
    alphabet, code = np.unique(points, return_inverse=True)
    letters = len(alphabet)
    at = np.arange(1, len(points) - longest)
    number, grams = np.zeros(len(at), np.int64), np.zeros((1, 0), np.uint32)
    for k in range(longest):
        inside = alphabet[code[at + k]] > 0
        at, number = at[inside], number[inside]
        if not len(at):
            return
        keys, number, _ = _numbered(number * letters + code[at + k], len(grams) * letters)
        grams = np.column_stack([grams[keys // letters], alphabet[keys % letters]]).astype("<u4")
        for side, beside in enumerate((at - 1, at + k + 1)):
            keys, _, n = _numbered(number * letters + code[beside], len(grams) * letters)
            words = np.ascontiguousarray(grams[keys // letters]).view(f"<U{k + 1}").ravel()
            neighbours = alphabet[keys % letters].astype("<u4").view("<U1")  # the code point 0 becomes an empty text
            columns = [pa.array(words), pa.array(np.full(len(keys), side, np.int32)), pa.array(neighbours), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "side", "neighbour", "n"])


def gram_counts(texts: DataFrame, column: str = "text", longest: int = LONGEST) -> DataFrame:
    """(gram, side, neighbour, n) of all Han runs' stretches of 1 to ``longest`` characters with their neighbours before (side 0) and after (1), empty at a run's edge.

    A task counts its texts about ``SPAN`` characters at a time, however long a text or a run is; only
    counts move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points in _stretches(batches, longest):
            yield from _counted(points, longest)

    counts = texts.select(column).mapInArrow(run, "gram string, side int, neighbour string, n long")
    return counts.groupBy("gram", "side", "neighbour").agg(F.sum("n").alias("n"))


def _grams(counts: DataFrame) -> DataFrame:
    """(gram, n, freedom): how often, and the lesser entropy of the neighbours of its two edges. An edge of a run is a neighbour of its own each time."""
    each = F.when(F.col("neighbour") != "", F.col("n") * F.log("n")).otherwise(0.0)
    known = [F.sum(F.when(F.col("side") == side, each).otherwise(0.0)).alias(f"known{side}") for side in (0, 1)]
    total = counts.withColumn("n", F.col("n").cast("double")).groupBy("gram").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("all"), *known)
    free = [F.log("all") - F.col(f"known{side}") / F.col("all") for side in (0, 1)]
    return total.select("gram", F.col("all").alias("n"), F.least(*free).alias("freedom"))


def learn(
    texts: DataFrame, column: str = "text", longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM
) -> DataFrame:
    """(word, n, cohesion, freedom) of what the texts use as words of 2 to ``longest`` characters.

    cohesion: the least logarithm, over the cuts into two parts, of how much more often the parts
    stand together than by chance. freedom: the lesser entropy of the neighbours of its two
    edges. Null texts and texts without Han characters add nothing.
    """
    grams = _grams(gram_counts(texts, column, longest))
    n = grams.where(F.col("n") >= least)
    size = grams.where(F.length("gram") == 1).agg(F.sum("n").alias("size"))  # one row
    cuts = F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("cut")
    parts = n.where((F.length("gram") > 1) & (F.col("freedom") >= freedom)).select("gram", "n", "freedom", cuts).select(
        "gram", "n", "freedom", F.substring("gram", F.lit(1), F.col("cut")).alias("left"), F.substring("gram", F.col("cut") + 1, F.lit(longest)).alias("right")
    )
    left, right = n.select(F.col("gram").alias("left"), F.col("n").alias("l")), n.select(F.col("gram").alias("right"), F.col("n").alias("r"))
    both = parts.join(left, "left").join(right, "right").join(F.broadcast(size), how="cross")
    bound = both.groupBy("gram", "n", "freedom").agg(F.min(F.log("n") + F.log("size") - F.log("l") - F.log("r")).alias("cohesion"))
    found = bound.where(F.col("cohesion") >= cohesion)
    return found.select(F.col("gram").alias("word"), F.col("n").cast("long").alias("n"), "cohesion", "freedom")


def best_path(run: str, cost: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of least total cost that make up the run; of equal ones the longest last word. A single character is always a word."""
    total, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        best, at = math.inf, end - 1
        for start in range(max(0, end - longest), end):
            word = run[start:end]
            step = cost.get(word, unknown if end - start == 1 else math.inf)
            if total[start] + step < best - 1e-12:
                best, at = total[start] + step, start
        total.append(best)
        back.append(at)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def tokenizer(words: DataFrame, most: int = MOST_WORDS) -> Callable[[Column], Column]:
    """A tokenizer of text columns by a learnt dictionary (word, n), for every operator that takes one.

    A word costs the negative logarithm of its share of all words' occurrences, an unknown
    character more than the rarest word. The ``most`` frequent words go to each task. Text in other
    scripts gives its lower-case runs of word characters.
    """
    rows = words.orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()
    total = sum(r["n"] for r in rows) or 1
    cost = {r["word"]: math.log(total) - math.log(r["n"]) for r in rows}
    longest = max(map(len, cost), default=1)
    unknown = math.log(total) + 1.0
    held = words.sparkSession.sparkContext.broadcast(cost)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tokens in batches:
            known: dict[str, list[str]] = {}
            out = []
            for row in tokens:
                words_of: list[str] = []
                for part in row:
                    if not ("㐀" <= part[0] <= "鿿"):
                        words_of.append(part)
                        continue
                    if part not in known:
                        known[part] = best_path(part, held.value, longest, unknown)
                    words_of += known[part]
                out.append(words_of)
            yield pd.Series(out, index=tokens.index)

    def of(text: Column) -> Column:
        lower = F.lower(F.coalesce(text, F.lit("")))
        inside = HAN[1:-1]
        found = F.regexp_extract_all(lower, F.lit(rf"{HAN}+|(?U)[\w&&[^{inside}]]+"), F.lit(0))
        return cut(found)

    return of
