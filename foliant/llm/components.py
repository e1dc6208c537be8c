"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, stash

#: Rows of a node's minimum are copied so often, so that a hub's edges meet in as many tasks.
SALTS = 8


def _with_minimum(edges: DataFrame, side: str, minima: DataFrame) -> DataFrame:
    """Edges with the minimum ``m`` of the node in column ``side``; hubs are spread over salts."""
    other = "hi" if side == "lo" else "lo"
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = minima.withColumnRenamed("u", side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [side, "salt"]).drop("salt")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(node, component) of every node that an edge names; component is the least node reachable.

    Edges with a null end or equal ends are ignored. An empty table gives an empty table.
    ``rows``, if known, is the most that ``edges`` has.
    Each round moves at most two rows an edge; rounds grow with the logarithm of the diameter.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = stash(e.distinct(), "edges", rows)
    mark = _mark(e)
    while mark[0]:
        ends = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_minimum(e, "lo", least).select("hi", F.col("m").alias("lo")).where("hi > lo").distinct()
        large = stash(large, "large", mark[0])
        nearest = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = (
            _with_minimum(large, "hi", nearest)
            .where("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(nearest.select("u", "m"))
        )
        new = stash(small.distinct(), "edges", 2 * mark[0])
        discard(e, large)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
