"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, stash, with_field
from foliant.llm.components import connected_components
from foliant.llm.groups import Unions, by_bucket, salted_join, sorted_by_bucket, split_buckets

BITS = 64
SAMPLE = 8192
#: Rows of a bucket block; a bucket beyond it is compared by more than one task.
BLOCK = 1024
#: Vectors of a label that are to meet in a table's bucket, and bounds of the bits of a table's key.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 4, 10, 24
#: Share of the pairs at just the threshold that may meet in no table if bits were independent.
MISSED = 0.02


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """(tables, bits of a key) for labels of at most ``rows`` vectors: a bucket's size does not grow with them.

    A bit differs with the share of the angle in a half turn, and more bits a key need more
    tables to keep the recall.
    """
    bits = int(np.clip(np.ceil(np.log2(max(rows, 1) / BUCKET_ROWS)), LEAST_BITS, MOST_BITS))
    agree = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-agree)))) if agree < 1 else 1, bits


def learn(vectors: np.ndarray, seed: int = 0, steps: int = 40, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` coordinates whose signs are the code) of unit vectors.

    Principal axes are turned by the rotation that brings them closest to the corners of the
    hypercube: codes are the signs, then the rotation is refitted to the codes (Procrustes).
    With fewer axes than bits more rotations follow from other starts.
    """
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:bits].T
    low = centred @ axes
    out: list[np.ndarray] = []
    while sum(p.shape[1] for p in out) < bits:
        rng = np.random.default_rng((seed, len(out)))
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(steps):
            codes = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(codes.T @ low)
            turn = (u @ v).T
        out.append(axes @ turn)
    return mean, np.hstack(out)[:, :bits]


def keys_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: int) -> np.ndarray:
    """(row, table): the substring of the code in each table, as a number."""
    signs = (vectors - mean) @ projection >= 0
    signs = signs.reshape(len(vectors), tables, -1)
    return (signs << np.arange(signs.shape[2])).sum(axis=2)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows of doubles; vectors of another length are cut or filled with zeros for the code only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(column), size))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row[at < size], at[at < size]] = flat[at < size]
    return out


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    sample: int = SAMPLE,
) -> DataFrame:
    """Link vectors of the same label whose cosine, in double precision, is at least ``threshold``.

    Returns per row: vec_id, n_links (other vectors linked directly), component_id (the smallest
    vec_id reachable), kept (vec_id = component_id).

    The rotation is learnt from at most ``sample`` vectors; every vector is indexed. Vectors
    meet if their codes agree in the key of one of the tables, whose number and bits follow from
    the size of the largest label (``tables_for``), and are then compared in full, so no link is wrong; the recall of links is measured in the README. Equal vectors are
    one class with their number as weight, so a group of copies is one row. A pair that meets
    in more tables counts in the first; links are counted where they are found, and only a
    spanning forest of each bucket leaves its task.

    Null labels, null, empty, zero or non-finite vectors and vectors of other lengths link with
    nothing. Rows that repeat a vec_id are vectors of their own; a null vec_id sorts after all
    others. Other columns may have any name. An empty table gives an empty result.
    """
    own = pick(vectors, vec_id=vec_id, embedding=embedding, label=label)
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    own = own.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # 128 bits that name the label with the vector where rows meet their class again
    names = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2")]
    rows = stash(own.withColumn("uid", F.monotonically_increasing_id()).select("*", *names), "vectors")
    first = F.struct(F.col("vec_id").isNull(), "vec_id", "uid")
    classes = rows.where("usable").groupBy("label", "embedding").agg(
        F.min("uid").alias("node"), F.count("*").alias("weight"), F.min(first).alias("first"),
        F.min("h1").alias("h1"), F.min("h2").alias("h2"),
    )
    classes = stash(classes, "vector-classes")
    few = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toArrow()
    size = max((len(v) for v in few.column("embedding").to_pylist()[:1]), default=1)
    points = _matrix(few.column("embedding"), size) if few.num_rows else np.eye(1)
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, bits = tables_for(largest, threshold)
    units = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    mean, projection = learn(units, bits=tables * bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), size)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            got = keys_of(x, mean, projection, tables).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "keys"])

    plain = classes.select("node", "weight", "label", "embedding")
    coded = stash(plain.mapInArrow(code, with_field(plain.schema, "keys", "array<int>")), "codes")
    indexed = coded.select("*", F.posexplode("keys").alias("t", "key"))
    dealt = split_buckets(indexed, ["label", "t", "key"], "node", BLOCK)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches):
            node, weight = (table.column(c).to_numpy() for c in ("node", "weight"))
            block, t = table.column("block").to_numpy(), table.column("t")[0].as_py()
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)[:, :t]
            lists = table.column("embedding").combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            x = _matrix(lists, int(lengths.max()))
            norm = np.linalg.norm(x, axis=1)
            cross = table.column("cross")[0].as_py()
            links = np.zeros(len(node), np.int64)
            unions = Unions(len(node))
            for at in range(0, len(node), 256):
                some = slice(at, at + 256)
                near = (x[some] @ x.T) / (norm[some, None] * norm[None, :]) >= threshold
                near &= lengths[some, None] == lengths[None, :]
                if cross:
                    near &= block[some, None] != block[None, :]
                p, q = np.nonzero(near)
                p = p + at
                new = (p != q) & (keys[p] != keys[q]).all(axis=1)  # not found in an earlier table
                p, q = p[new], q[new]
                links += np.bincount(p, weight[q], len(node)).astype(np.int64)
                unions.add(p[p < q], q[p < q])
            root = unions.settle()
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], names=["node", "root", "links"]
                )

    found = sorted_by_bucket(dealt).select("bucket", "node", "weight", "block", "t", "keys", "embedding", "cross")
    found = stash(found.mapInArrow(link, "node long, root long, links long"), "links")
    labels = connected_components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = stash(labels.join(classes.select("node", "first"), "node"), "named-vectors")
    firsts = named.groupBy("component").agg(F.min("first").alias("least"))
    least = salted_join(named.select("node", "component"), firsts, ["component"], "node").select("node", "least")
    members = stash(
        classes.select("node", "weight", "first", "h1", "h2")
        .join(counts, "node", "left")
        .join(least, "node", "left")
        .select(
            "h1",
            "h2",
            F.coalesce("least", "first").alias("least"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "vector-members",
    )
    discard(classes, coded, found, named)
    linked = salted_join(rows.where("usable").select("vec_id", "uid", "h1", "h2"), members, ["h1", "h2"], "uid")
    linked = linked.select("vec_id", "n_links", F.col("least.vec_id").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
