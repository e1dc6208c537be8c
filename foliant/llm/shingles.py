"""Shingles of texts as hashes, and the exact join of their sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, stash
from foliant.llm.groups import by_bucket, sorted_by_bucket, split_buckets

#: Postings of a shard, whose lists one task compares; a shard with more is compared by more tasks.
SHARD = 1 << 16
#: Pairs, or hashes, that a task holds at a time.
HELD = 1 << 20
#: Share of all hashes that says which texts have no partner, and nodes that are broadcast at most.
SKETCH, FEW = 0.35, 1 << 20
#: What bounds in floating point are lowered by; pairs at a bound are decided on their texts.
SLACK = 1e-6


def hashes_of(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a text with fewer words has one shingle, one without words none."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(own))
    digest = xxhash.xxh64_intdigest
    n = len(own) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def chosen(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``node`` is in ``nodes``; texts stay where they are while the nodes are ``FEW``."""
    return texts.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi")


def _shingles(texts: DataFrame, shingle: int, similarity: float, share: float = 1.0) -> DataFrame:
    """(node, size, need, h): the set of each text's shingles, a row each, or this share of all hashes, the lowest.

    Of the rows of a text at least ``need`` are in any text that similar, as so many may differ at most. A text
    of which nothing is needed has one row at least.
    """
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                hashes = np.unique(hashes_of(text.as_py(), shingle))
                low = hashes[: max(1, int(np.searchsorted(hashes, limit, "right")))]
                need = len(low) - len(hashes) + int(np.ceil(similarity * len(hashes) - SLACK))
                held.append((node, len(hashes), need, low))
                n += len(low)
                if n >= HELD:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        counts = [len(x[3]) for x in held]
        columns = [np.repeat(np.array(c, np.int64), counts) for c in list(zip(*held))[:3]]
        hashes = np.concatenate([x[3] for x in held]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, hashes)], names=["node", "size", "need", "h"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, need long, h long")


def sharing(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The nodes that share enough of their ``SKETCH`` of all hashes with others; those left out have no partner."""
    rows = _shingles(texts, shingle, similarity, SKETCH).drop("size")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1 OR need <= 0")
    return rows.groupBy("node").agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("node")


def open_pairs(texts: DataFrame, labels: DataFrame, shingle: int, similarity: float, rows: int | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of different components, among them every one whose sets of shingles are so similar.

    ``texts`` has the text of each node (at most ``rows``, if known), and ``labels`` (node, component) what is linked already. A share of
    all shingles says of most texts that too many are theirs alone. The shingles of the others are
    ordered by how many of these nodes have them, the rare ones first. Two similar sets have one in common
    in the prefix that holds one shingle more than may differ, so nodes meet where prefixes do. A shingle of
    one node is sent nowhere then, and a line that many texts have is met only if little else is in
    them. A pair passes if what follows the shingle in both sets is enough for the similarity; at
    their first common one it is, if they are similar.
    """
    alive = stash(sharing(texts, shingle, similarity), "sharing", rows)
    rows = _shingles(chosen(texts, alive), shingle, similarity).drop("need")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    own = Window.partitionBy("node")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("n", "h"))).withColumn("shared", F.count("*").over(own))
    rows = rows.withColumn("rest", F.col("shared") - F.col("rank") + 1)  # this shingle and all after it
    rows = rows.where(F.col("rest") >= F.ceil(F.lit(similarity) * F.col("size") - F.lit(SLACK)))
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = Window.partitionBy("h")
    rows = rows.withColumn("least", F.min("component").over(lists)).withColumn("most", F.max("component").over(lists))
    rows = stash(rows.where("least < most").select("h", "node", "size", "rest", "component"), "postings")
    discard(alive)
    shards = max(1, rows.count() // (SHARD // 2))
    dealt = split_buckets(rows.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(13)), F.lit(shards))), ["shard"], "node", SHARD)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches):
            h, node, size, rest, component = (table.column(c).to_numpy() for c in ("h", "node", "size", "rest", "component"))
            block = table.column("block").to_numpy() if table.column("cross")[0].as_py() else None
            for i, j in open_pairs_in(h, size, rest, component, similarity, block):
                ends = np.unique(np.sort(np.stack([node[i], node[j]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return sorted_by_bucket(dealt.drop("shard")).mapInArrow(link, "a long, b long")


def open_pairs_in(
    h: np.ndarray, size: np.ndarray, rest: np.ndarray, component: np.ndarray, similarity: float, block: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows with equal ``h`` and different components, where the lesser rest is enough for the similarity, some at a time."""
    order = np.lexsort((component, h))
    cuts = np.flatnonzero(h[order][1:] != h[order][:-1]) + 1
    starts, stops = np.r_[0, cuts], np.r_[cuts, len(order)]

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = component[i] != component[j]
        ok &= np.minimum(rest[i], rest[j]) * (1 + similarity) >= similarity * (size[i] + size[j]) - SLACK
        if block is not None:
            ok &= block[i] != block[j]
        i, j = np.broadcast_arrays(i, j)
        return i[ok], j[ok]

    at = np.arange(len(order))
    stop = np.repeat(stops, stops - starts)
    at = at[np.repeat(stops - starts <= 64, stops - starts)]
    for step in range(1, 64):  # short lists together: each row and the one so many rows on
        at = at[at + step < stop[at]]
        if not len(at):
            break
        i, j = passing(order[at], order[at + step])
        if len(i):
            yield i, j
    for a, b in zip(starts, stops):
        if b - a <= 64:
            continue
        rows = order[a:b]
        ends = np.searchsorted(component[rows], component[rows], "right")
        k = 0
        while k < len(rows) and ends[k] < len(rows):  # only with later components, which follow the row's own
            later = rows[ends[k] :]
            some = min(len(rows) - k, max(1, HELD // len(later)))
            # rows of the chunk's own later components are met from the lesser side alone
            i, j = passing(rows[k : k + some, None], later[None, :])
            once = component[i] < component[j]
            if once.any():
                yield i[once], j[once]
            k += some
