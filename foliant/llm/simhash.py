"""SimHash near-duplicates: a forest of vantage-point trees finds every pair of close fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, stash, with_field
from foliant.llm.components import connected_components
from foliant.llm.groups import Forests, Unions, by_bucket, salted_join, sorted_by_bucket, split_buckets
from foliant.llm.shingles import chosen, hashes_of, open_pairs

BITS = 64
#: Rows of a bucket block; a bucket beyond it is compared by more than one task.
BLOCK = 1 << 17
#: Pairs that a task compares at a time.
PAIRS = 1 << 21
#: Words of a fingerprint that estimates similarities, and those of them that have trees.
WIDE, INDEXED = 8, 4
#: Spanning forests of a shard's links whose pairs are compared exactly.
FORESTS = 3
#: Pairs of one text that a task compares exactly; a text with more is sent to more tasks.
MANY = 256


def distance_of(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of ``bits`` bits differ at this Jaccard similarity of their shingles, and two standard errors.

    Sets of similarity s have the cosine 2s / (1 + s) if they are of one size, and a bit
    differs with the share of their angle in a half turn. With 512 bits the standard error at
    0.8 is 8 bits, or 0.025 of similarity; so 49 of 50 pairs at just that similarity are
    within the distance.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * share + 2 * (bits * share * (1 - share)) ** 0.5)


def same_share(one: str | None, other: str | None, shingle: int) -> float:
    """The exact Jaccard similarity of the sets of word shingles of two texts.

    Words and shingles are those of ``fingerprint``. Two texts without words are equal.
    """
    a, b = ((t or "").encode("utf-8", "replace").lower().split() for t in (one, other))
    if not a or not b:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < shingle:  # a short text has one shingle: all its words
        sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} for w in (a, b)]
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    words = pa.array([*a, *b], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    codes = words
    for k in range(1, shingle):  # runs of k words are numbered; with the next word they are runs of k + 1
        codes = np.unique(codes[:-1] * len(words) + words[k:], return_inverse=True)[1]
    seen = np.zeros((2, codes.max() + 1), bool)
    seen[0, codes[: len(a) - shingle + 1]] = True
    seen[1, codes[len(a) :]] = True
    return float((seen[0] & seen[1]).sum() / (seen[0] | seen[1]).sum())


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a whole text over its word shingles, repeats included.

    Words are runs of other characters than ASCII white space, with A-Z lower-cased. A text
    with fewer words than a shingle has one shingle, one without words has fingerprint 0.
    """
    return int(code(text, shingle)[0])


def code(text: str | None, shingle: int = 4, words: int = 1, distinct: bool = False) -> np.ndarray:
    """``fingerprint`` as an array; more words than one take their bits from the same hashes, mixed again.

    With ``distinct``, a shingle that repeats counts once.
    """
    hashes = hashes_of(text, shingle)
    return _majority(np.unique(hashes) if distinct else hashes, words)


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits that are set in over half the hashes, for so many words; without hashes they are zero."""
    ones = np.zeros((words, BITS), np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        for w in range(words):
            bits = np.unpackbits(_mixed(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[w] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes for another word of the fingerprint."""
    if not word:
        return h
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_columns(words: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, words))]


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """``docs`` plus ``fp`` (and ``fp1``, ...), the fingerprint of the text as signed longs.

    With ``distinct``, a shingle that repeats counts once, and the set of hashes adds its ``size``
    and its ``digest``.
    """
    out = docs.schema
    at = out.fieldNames().index(text)
    for name in word_columns(words):
        out = with_field(out, name, "long")
    for name in ("size", "digest") if distinct else ():
        out = with_field(out, name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            fps, sizes, digests = [], [], []
            for k in range(0, len(column), 256):
                for t in column.slice(k, 256).to_pylist():
                    if not distinct:
                        fps.append(code(t, shingle, words))
                        continue
                    hashes = np.unique(hashes_of(t, shingle))
                    fps.append(_majority(hashes, words))
                    sizes.append(len(hashes))
                    digests.append(np.bitwise_xor.reduce(_mixed(hashes, words), initial=np.uint64(0)))
            table = np.array(fps, np.uint64).reshape(-1, words).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(table[:, w])) for w in range(words)]
            if distinct:
                columns += [pa.array(sizes, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=out.fieldNames())

    return docs.mapInArrow(run, out)


class VantageTree:
    """A vantage-point tree over some bits of the fingerprints, kept as arrays.

    An inner node sends a fingerprint inside if its distance from the vantage point is at most
    the node's radius, else outside. Two fingerprints within ``reach`` whose ways part there
    differ by at most ``reach`` in that distance (triangle inequality), so only the inside ones
    with distance + reach > radius need a copy outside; all other branches are pruned. So the
    two always meet in a leaf, where either may be a copy.
    """

    def __init__(self, sample: np.ndarray, mask: int, reach: int, depth: int, seed: int = 0):
        self.mask, self.reach = np.uint64(mask), reach
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.child: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(np.unique(sample & self.mask), depth, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        """The node's number; a leaf is ~number."""
        best = None
        if depth and len(points) >= 2:
            for v in rng.choice(points, min(8, len(points)), replace=False):
                d = np.bitwise_count(points ^ v)
                for radius in {int(np.median(d)), int(np.median(d)) - 1}:
                    inside = d <= radius
                    band = (inside & (d + self.reach > radius)).mean()
                    cost = abs(inside.mean() - 0.5) + band
                    if inside.any() and not inside.all() and (best is None or cost < best[0]):
                        best = (cost, v, radius, inside)
        if best is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        _, v, radius, inside = best
        node = len(self.vantage)
        self.vantage.append(int(v))
        self.radius.append(radius)
        self.child.append((0, 0))
        self.child[node] = (self._grow(points[inside], depth - 1, rng), self._grow(points[~inside], depth - 1, rng))
        return node

    def shards(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indices) of all the shards to visit."""
        todo = [(self.root, np.arange(len(fps)))]
        masked = fps & self.mask
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                yield ~node, idx
                continue
            d = np.bitwise_count(masked[idx] ^ np.uint64(self.vantage[node])).astype(np.int64)
            todo.append((self.child[node][0], idx[d <= self.radius[node]]))
            todo.append((self.child[node][1], idx[d + self.reach > self.radius[node]]))


def forest(sample: np.ndarray, distance: int, trees: int, depth: int) -> list[VantageTree]:
    """Trees over disjoint groups of bits.

    Of ``trees`` groups, two fingerprints within ``distance`` differ in at most
    distance // trees bits of at least one, so each tree needs that reach only.
    """
    cuts = np.linspace(0, BITS, trees + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:])]
    return [VantageTree(sample, m, distance // trees, depth, seed=i) for i, m in enumerate(masks)]


def close_pairs_in(
    codes: np.ndarray, parts: list[tuple[int, np.uint64]], distance: int, block: np.ndarray | None, forests: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between rows of ``codes`` (rows, words) that join what close pairs of these rows join.

    They lead from each row to the least one that it reaches. With ``forests`` they are close
    pairs themselves, those of so many spanning forests of the least distances.

    Two rows that a tree's reach joins agree in one of ``parts`` (word, mask) of its bits, so
    only rows that do are compared, over all words. With ``block``, only rows of different
    blocks are.
    """
    unions, best = Unions(len(codes)), Forests(forests)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        apart = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=-1, dtype=np.int64)
        near = (apart <= distance) & (i < j)
        if block is not None:
            near &= block[i] != block[j]
        ends = [x[near] for x in np.broadcast_arrays(i, j)]
        best.add(*ends, apart[near]) if forests else unions.add(*ends)

    for word, mask in parts:
        value = codes[:, word] & mask
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(value[order][1:] != value[order][:-1]) + 1
        starts, stops = np.r_[0, cuts], np.r_[cuts, len(order)]
        at = np.arange(len(order))
        stop = np.repeat(stops, stops - starts)
        at = at[np.repeat(stops - starts <= 64, stops - starts)]
        for step in range(1, 64):  # small groups together: each row and the one so many rows on
            at = at[at + step < stop[at]]
            if not len(at):
                break
            compare(order[at], order[at + step])
        for a, b in zip(starts, stops):
            if b - a > 64:
                rows = order[a:b]
                some = max(1, PAIRS // (len(rows) * codes.shape[1]))
                for k in range(0, len(rows), some):
                    compare(rows[k : k + some, None], rows[None, k:])
    if forests:
        return best.settle()
    label = unions.settle()
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return moved, label[moved]


def close_pairs_forest(
    fps: DataFrame,
    distance: int,
    trees: int,
    leaf: int,
    sample: int,
    node: str = "fp",
    words: int = 1,
    indexed: int = 1,
    reach: int | None = None,
    forests: int = 0,
) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints that connect those within ``distance``.

    Each of the first ``indexed`` words of a fingerprint has ``trees`` trees over groups of its bits. Without ``reach``
    there is one word, and each tree reaches distance // trees bits, so every pair is found.
    With it, pairs are found that differ by at most ``reach`` bits in one of all these groups.
    Vantage points come from at most ``sample`` fingerprints of least hash, which bounds what
    the driver holds; every fingerprint is indexed. A shard emits a spanning forest of its
    links, never all its pairs; with ``forests`` so many of them, and all edges are close pairs.
    """
    columns = word_columns(words)
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(n / leaf, 1)))))
    few = fps.select(*columns[:indexed]).orderBy(F.xxhash64(*columns, F.lit(3)), *columns).limit(sample).toArrow()
    near = distance // trees if reach is None else reach
    built, parts = [], []
    for w, name in enumerate(columns[:indexed]):
        for tree in forest(few.column(name).to_numpy().view(np.uint64), near * trees, trees, depth):
            built.append((w, tree))
            parts.append([(w, m) for m in _parts(int(tree.mask), near + 1)])
    shipped = fps.sparkSession.sparkContext.broadcast(built)
    names = list(dict.fromkeys([node, *columns]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, (w, tree) in enumerate(shipped.value):
                got = list(tree.shards(batch.column(columns[w]).to_numpy(zero_copy_only=False).view(np.uint64)))
                if not got:
                    continue
                idx = np.concatenate([i for _, i in got])
                leaves = np.repeat([leaf for leaf, _ in got], [len(i) for _, i in got])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(idx), t, np.int32)),
                        pa.array(leaves.astype(np.int32)),
                        *(batch.column(c).take(pa.array(idx)) for c in names),
                    ],
                    names=["tree", "leaf", *names],
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches):
            if forests:  # equal distances are decided alike in all shards
                table = table.sort_by(node)
            codes = np.stack([table.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
            block = table.column("block").to_numpy() if table.column("cross")[0].as_py() else None
            i, j = close_pairs_in(codes, parts[table.column("tree")[0].as_py()], distance, block, forests)
            if len(i):
                ends = table.column(node).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ends[i]), pa.array(ends[j])], names=["a", "b"])

    longs = ", ".join(f"{c} long" for c in names)
    routed = fps.select(*names).mapInArrow(route, f"tree int, leaf int, {longs}")
    dealt = split_buckets(routed, ["tree", "leaf"], node, BLOCK)
    return sorted_by_bucket(dealt.drop("leaf")).mapInArrow(link, "a long, b long")


def _parts(mask: int, parts: int) -> list[np.uint64]:
    """The mask's bits in so many groups: of values that differ in fewer bits than groups, one group agrees."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    cuts = np.linspace(0, len(bits), parts + 1).astype(int)
    return [np.uint64(sum(1 << b for b in bits[x:y])) for x, y in zip(cuts[:-1], cuts[1:])]


def confirmed(edges: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts have this exact similarity of their word shingles, or more.

    ``texts`` has one row (node, text) a node. Only texts of an edge are moved, and a text with
    more than ``MANY`` edges goes to one more task for each so many.
    """
    edges = stash(edges.distinct(), "pairs")
    texts = chosen(texts, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    dealt, sent = edges, []
    for side, other in (("a", "b"), ("b", "a")):
        counts = edges.groupBy(side).agg(F.ceil(F.count("*") / MANY).cast("int").alias("tasks"))
        dealt = salted_join(dealt, counts.where("tasks > 1"), [side], other, "left")
        task = F.pmod(F.xxhash64(other, F.lit(11)), F.coalesce("tasks", F.lit(1))).cast("int")
        dealt = dealt.withColumn(f"task_{side}", task).drop("tasks")
        own = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")).join(counts, side)
        sent.append((side, own.withColumn(f"task_{side}", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")))
    for side, own in sent:
        dealt = dealt.join(own, [side, f"task_{side}"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("text_a"), batch.column("text_b")
            pairs = ((x.as_py(), y.as_py()) for x, y in zip(one, other))
            alike = np.array([same_share(x, y, shingle) >= similarity for x, y in pairs], bool)
            yield batch.select(["a", "b"]).filter(pa.array(alike))

    return dealt.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    trees: int = 3,
    leaf: int = 4096,
    sample: int = 16384,
    keep_row: bool = False,
    similarity: float | None = None,
) -> DataFrame:
    """Link documents whose fingerprints differ in at most ``distance`` bits, and name their components.

    Returns per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable), kept (true for one row of each component: the one with that doc_id) and, with
    ``keep_row``, the input row as struct ``record``.

    With ``similarity``, documents link if the Jaccard similarity of their sets of shingles is
    at least that (``distance`` is not read), and no such link is lost. Fingerprints of ``WIDE``
    words, where a shingle counts once, find most of them by the forest; an exact join of the sets
    (``shingles.open_pairs``) then finds every pair that might join two of the components so
    far. Each link is confirmed on the whole texts, so no row goes without a text that similar.
    Texts with equal sets are one. The fingerprint returned is the first word.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id are rows of their own. A null doc_id sorts after all others. Other columns of the
    input are not read and may have any name.
    """
    own = pick(docs, doc_id=doc_id, text=text)
    if keep_row:
        record = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("record")
        own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), record)
    words = 1 if similarity is None else WIDE
    columns = word_columns(words)
    alike = columns if similarity is None else [*columns, "size", "digest"]
    marked = fingerprints(own, "text", shingle, words, similarity is not None).withColumn("uid", F.monotonically_increasing_id())
    if similarity is None or keep_row:  # the record holds the text already
        marked = marked.drop("text")
    marked = stash(marked, "fingerprints")
    rows = marked.count()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    classes = marked.groupBy(*alike).agg(F.min(order).alias("first"), F.min("uid").alias("node"))
    classes = stash(classes, "classes", rows)
    if similarity is None:
        edges = close_pairs_forest(classes, distance, trees, leaf, sample, "node")
    else:
        far = distance_of(similarity, BITS * words)
        edges = close_pairs_forest(classes, far, trees, 2 * leaf, sample, "node", words, INDEXED, reach=1, forests=FORESTS)
        whole = F.col("record")[text] if keep_row else F.col("text")
        texts = chosen(marked.select(F.col("uid").alias("node"), whole.alias("text")), classes.select("node"))
        edges = stash(confirmed(edges, texts, shingle, similarity), "links")
        linked = stash(connected_components(edges, "a", "b", edges.count()), "linked", rows)
        others = open_pairs(texts, linked, shingle, similarity, rows)
        edges = edges.union(confirmed(others, texts, shingle, similarity))
    labels = stash(connected_components(edges, "a", "b").join(classes.select("node", "first"), "node"), "labels", rows)
    firsts = labels.groupBy("component").agg(F.min("first").alias("least"))
    least = salted_join(labels.select("node", "component"), firsts, ["component"], "node").select("node", "least")
    members = classes.join(least, "node", "left").select(*alike, F.coalesce("least", "first").alias("first"))
    members = stash(members, "members", rows)
    discard(classes, labels)
    out = marked.join(members, alike)
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        *(["record"] if keep_row else []),
    )
