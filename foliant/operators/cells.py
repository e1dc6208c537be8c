"""Approximate vector search by inverted cells: vectors are stored by their nearest centre, and a search reads the nearest cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.retrieval import cosine_topk, of_books

#: Bounds: cells (a folder each), and vectors that the centres are learnt from.
MOST_CELLS, SAMPLE = 4096, 200_000
#: The cell of vectors without a direction; it is read last.
NOWHERE = -1
#: Of the rows asked for, the share that a search reads at least.
SHARE = 0.1


@dataclass(frozen=True)
class Cells:
    """A stored index: vectors by cell, the rows of each book in each cell, and the centres (at most MOST_CELLS)."""

    spark: SparkSession
    path: str
    cells: np.ndarray
    centres: np.ndarray

    @property
    def vectors(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema  # there may be no vector at all
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")


def _doubles() -> Column:
    return F.col("vector").cast("array<double>")


def finite() -> Column:
    """Whether a vector is not null and has no null or non-finite parts."""
    return F.coalesce(F.forall(_doubles(), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def directed() -> Column:
    """Whether a vector is finite and not zero."""
    return finite() & F.exists(_doubles(), lambda x: x != 0)


def _assigned(vectors: DataFrame, model) -> DataFrame:
    """``vectors`` with ``cell``; the centres travel with the model, whose size is bounded."""
    good = vectors.where(directed()).withColumn("features", array_to_vector(_doubles()))
    placed = model.transform(good).drop("features").withColumnRenamed("prediction", "cell")
    return placed.unionByName(vectors.where(~directed()).withColumn("cell", F.lit(NOWHERE)))


def _append(vectors: DataFrame, model, path: str) -> None:
    # a large cell is split over tasks and files; books are together in a file, so that its filter skips row groups
    rows = _assigned(vectors, model).hint("rebalance", "cell").sortWithinPartitions("cell", "book_id", "id")
    rows.write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def _counted(index: Cells) -> Cells:
    counts = index.vectors.groupBy("cell", "book_id").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{index.path}/counts")
    return index


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> Cells:
    """Store ``vectors`` (id, book_id, vector, ...) by cell under a new ``path``.

    Centres come from k-means by cosine on a sample of some SAMPLE vectors, chosen by hash; by
    default there are as many as the square root of the rows, at most MOST_CELLS. Every vector
    is stored: those without a direction in a cell of their own.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    vectors.limit(0).withColumn("cell", F.lit(NOWHERE)).write.parquet(f"{path}/schema")
    cells = min(cells or math.ceil(math.sqrt(n)), MOST_CELLS, max(n, 1))
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(n, 1)) * 1_000_000)
    sample = vectors.where(drawn & directed()).select(array_to_vector(_doubles()).alias("features"))
    if sample.isEmpty():
        rows = vectors.withColumn("cell", F.lit(NOWHERE))
        rows.write.partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame([], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    else:
        model = KMeans(k=max(cells, 2), seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
        model.save(f"{path}/model")
        _append(vectors, model, path)
        centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        spark.createDataFrame(centres, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return _counted(load(spark, path))


def load(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    centres = np.array([r["centre"] for r in rows], float) if rows else np.zeros((0, 0))
    return Cells(spark, path, np.array([r["cell"] for r in rows], int), centres)


def add(index: Cells, vectors: DataFrame) -> Cells:
    """Store more vectors in the cells that there are; ids that the index has already must be dropped before."""
    from pyspark.ml.clustering import KMeansModel

    _append(vectors.select(*[c for c in index.vectors.columns if c != "cell"]), KMeansModel.load(f"{index.path}/model"), index.path)
    return _counted(index)


def drop_books(index: Cells, book_ids: Sequence[str]) -> Cells:
    """Rewrite the cells that hold vectors of these books, without them; all other cells stay as they are."""
    held = [r["cell"] for r in index.counts.where(F.col("book_id").isin(*book_ids)).select("cell").distinct().collect()]  # at most MOST_CELLS + 1
    if held:
        asked = F.coalesce(F.col("book_id").isin(*book_ids), F.lit(False))
        left = index.vectors.where(F.col("cell").isin(*held) & ~asked)
        aside = f"{index.path}/rewritten"
        left.write.mode("overwrite").parquet(aside)
        kept = index.spark.read.parquet(aside)
        rows = kept.hint("rebalance", "cell").sortWithinPartitions("cell", "book_id", "id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{index.path}/vectors")
        full = {r["cell"] for r in kept.select("cell").distinct().collect()}
        for cell in set(held) - full:  # nothing is left of these
            at = index.spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/vectors/cell={cell}")
            at.getFileSystem(index.spark._jsc.hadoopConfiguration()).delete(at, True)
        _counted(index)
    return index


def probes(index: Cells, query: Sequence[float], k: int, book_ids: Sequence[str] | None, share: float) -> list[int]:
    """The cells to read: the nearest ones that together hold ``share`` of the rows of these books, and at least k."""
    counts = of_books(index.counts, book_ids).groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most MOST_CELLS + 1
    n = {r["cell"]: r["n"] for r in counts}
    q = np.asarray(query, float)
    near = index.centres @ q if len(index.cells) and np.isfinite(q).all() else np.zeros(len(index.cells))
    order = [int(index.cells[i]) for i in np.argsort(-near, kind="stable")] + [NOWHERE]
    wanted, found, out = max(share * sum(n.values()), min(k, sum(n.values()))), 0, []
    for cell in order:
        if found >= wanted:
            break
        if n.get(cell):
            out.append(cell)
            found += n[cell]
    return out


def topk(index: Cells, query: Sequence[float], k: int = 10, book_ids: Sequence[str] | None = None, share: float = SHARE) -> DataFrame:
    """The k nearest of the nearest cells (id, score), by exact cosine, ties by id.

    Only the folders of these cells are read, and in them the row groups of the books asked for.
    With ``share`` 1 all cells are read and the result is that of ``cosine_topk`` over the finite
    vectors; others are never hits.
    """
    read = index.vectors.where(F.col("cell").isin(*(probes(index, query, k, book_ids, share) or [NOWHERE])))
    read = read.where((F.col("cell") != NOWHERE) | finite())
    return cosine_topk(read, query, k, book_ids)
