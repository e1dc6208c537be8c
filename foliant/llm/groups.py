"""Comparing all rows within buckets when a bucket may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks that a hot key's rows are spread over where they meet the key's one row.
SALTS = 16


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``small``, which has one row a key.

    Rows of a key are dealt to ``salts`` tasks by a hash of ``spread``, and each row of
    ``small`` is copied so often; so a key with a third of all rows is not one task's.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread, F.lit(5)), F.lit(salts)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def split_buckets(rows: DataFrame, keys: list[str], spread: str, most: int) -> DataFrame:
    """Deal each bucket's rows to tasks of at most about ``2 * most`` rows that together compare all pairs.

    A bucket of n rows is cut into g = ceil(n / most) blocks by a hash of ``spread``. Block i
    goes to the tasks (min(i, j), max(i, j)) of every block j: the task (i, i) compares the
    pairs inside block i and the task (i, j) those across. Adds ``bucket`` (long, names a task),
    ``block`` and ``cross`` (whether two blocks meet there). No pair is lost, none is met twice.
    """
    large = rows.groupBy(*keys).count().where(F.col("count") > most)
    large = large.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    dealt = salted_join(rows, large, keys, spread, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(spread, F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return (
        dealt.withColumn("bucket", F.xxhash64(*keys, lo, hi))
        .withColumn("cross", F.col("block") != F.col("other"))
        .drop("blocks", "other")
    )


def by_bucket(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.Table]:
    """The rows of one bucket after another, from batches that are sorted by ``bucket``.

    A bucket with fewer than ``least`` rows gives nothing.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        if held and held[-1].column("bucket")[0].as_py() != key[0]:
            yield from _whole(held, least)
            held = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b == len(key):
                held.append(batch.slice(a, b - a))
            elif held:
                held.append(batch.slice(a, b - a))
                yield from _whole(held, least)
                held = []
            elif b - a >= least:
                yield pa.Table.from_batches([batch.slice(a, b - a)])
    if held:
        yield from _whole(held, least)


def _whole(parts: list[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    if sum(p.num_rows for p in parts) >= least:
        yield pa.Table.from_batches(parts)


def sorted_by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n items reaches over the links i-j."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


class Unions:
    """Links between n items, kept as the least item that each reaches; at most ``most`` links are held as such."""

    def __init__(self, n: int, most: int = 1 << 20):
        self.label, self.most = np.arange(n), most
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.held.append((i, j))
            self.size += len(i)
            if self.size > self.most:
                self.settle()

    def settle(self) -> np.ndarray:
        """The least item of each, all links counted."""
        if self.held:
            moved = np.flatnonzero(self.label != np.arange(len(self.label)))
            i, j = (np.concatenate(x) for x in zip(*self.held, (moved, self.label[moved])))
            self.label = roots(len(self.label), i, j)
            self.held, self.size = [], 0
        return self.label


class Forests:
    """The ``count`` best spanning forests of weighted links between items: at most that many links an item.

    The first is a minimum spanning forest, each next one that of the links not taken yet. So
    of the links that join two parts of the items the ``count`` least distant are always among
    them. Ties go to the lower items. At most ``most`` links beside them are held at a time.
    """

    def __init__(self, count: int, most: int = 1 << 20):
        self.count, self.most = count, most
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        """Links of items i < j."""
        if len(i):
            self.held.append(np.stack([distance, i, j]).astype(np.int64))
            self.size += len(i)
            if self.size > self.most:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the links taken."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        links = np.unique(np.concatenate(self.held, axis=1), axis=1)
        items, ends = np.unique(links[1:], return_inverse=True)
        ends = ends.reshape(2, -1)
        left, taken = np.arange(links.shape[1]), []
        for _ in range(self.count):
            took = left[_spanning(len(items), *ends[:, left])]
            taken.append(took)
            left = np.setdiff1d(left, took, assume_unique=True)
        kept = links[:, np.concatenate(taken)]
        self.held, self.size = [kept], 0
        return kept[1], kept[2]


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The links, by number, of the spanning forest of n items that prefers links of low number."""
    chosen = np.zeros(0, np.int64)
    open_ = np.arange(len(i))
    label = np.arange(n)
    while True:
        a, b = label[i[open_]], label[j[open_]]
        apart = a != b
        open_ = open_[apart]
        if not len(open_):
            return chosen
        best = np.full(n, len(i))
        np.minimum.at(best, a[apart], open_)
        np.minimum.at(best, b[apart], open_)
        chosen = np.union1d(chosen, best[best < len(i)])
        label = roots(n, i[chosen], j[chosen])
