"""Collocations by vertical positional inverted lists: frequent phrases grow by merge-joining their places with the next word's."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, stash
from foliant.llm.groups import by_bucket, sorted_by_bucket
from foliant.llm.words import BREAK, batched, kinds, runs

LEAST, LONGEST, TOP, COVERED = 100, 5, 2000, 100
UNDEFINED = "und"
#: Bytes between words, and those that end a piece of text.
PIECES = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
STATE, COUNTS, TOTALS = 0, 1, 2
#: Bytes of text of a block; longer texts are cut where a piece ends.
BLOCK_BYTES = 8 << 20
#: Slices of the counts for each task that reads or shuffles them.
SLICES = 3

# ``bucket`` is a block for a state and a slice for counts. Lists of a state: places of all
# phrases one after another (``at``, as gaps), the number and id of each (``phrases``).
# Entries of a slice are packed: word of the block and count, or phrase, word and count. What is
# frequent comes back to a block as word or phrase and word, and the new id.
LEVEL = "kind int, bucket long, block long, words binary, words_at binary, phrases binary, at binary, entries binary, " \
    "key array<string>, f array<long>"  # fmt: skip
KEPT = "kind int, bucket long, entries binary, key array<string>, a array<long>, b array<long>, id array<long>, f array<long>"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, plane by plane of their bytes, compressed; the first is best in rising order."""
    rows = np.array([np.diff(columns[0].astype(np.int64), prepend=0), *columns[1:]], np.int64)
    planes = rows.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(packed: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(columns, 8, -1)
    rows = planes.transpose(0, 2, 1).copy().view(np.int64).reshape(columns, -1)
    rows[0] = np.cumsum(rows[0])
    return rows


def pack_lists(n: np.ndarray, at: np.ndarray) -> bytes:
    """Places by list, each list rising, as bytes."""
    starts = (np.cumsum(n) - n)[n > 0]
    gaps = np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    return pack(np.cumsum(gaps, dtype=np.int64))


def unpack_lists(n: np.ndarray, packed: bytes) -> np.ndarray:
    ends = np.cumsum(n)
    sums = unpack(packed, 1)[0]
    before = np.r_[0, sums][ends - n]
    return (sums - np.repeat(before, n)).astype(np.int32)


def _types(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _parts(text: pa.Array) -> Iterator[pa.Array]:
    """One long text in parts of about BLOCK_BYTES that end where a piece ends."""
    raw = np.frombuffer(text[0].as_buffer(), np.uint8)
    at = 0
    while at < len(raw):
        stop = at + BLOCK_BYTES
        while stop < len(raw) and not (breaks := np.flatnonzero(PIECES[raw[stop : stop + 65536]] == BREAK)).size:
            stop += 65536
        stop = len(raw) if stop >= len(raw) else stop + int(breaks[0]) + 1
        yield pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, stop - at], np.int32)), pa.py_buffer(raw[at:stop]))
        at = stop


def _lists(code: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of places of each code, all places by code); places of a code stay in order."""
    return np.bincount(code, minlength=size).astype(np.int32), at[np.argsort(code, kind="stable")]


def word_lists(docs: DataFrame, slices: int) -> DataFrame:
    """A row for each block with the places of all its words, rows with the counts of its words by slice, and its totals.

    Words are those of a language: the key is the language and the word. Places number the words
    of a block and skip one where a piece or a text ends, so neighbours in a piece are one apart.
    """
    schema = _types(LEVEL)

    def rows_of(block: int, texts: pa.Array, langs: list[str]) -> Iterator[pa.RecordBatch]:
        coded, cuts, broken = runs(texts, PIECES)
        if not len(coded):
            return
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        new = np.r_[False, (text[1:] != text[:-1]) | (broken[1:] != broken[:-1])]
        at = (np.arange(len(text)) + np.cumsum(new)).astype(np.int32)
        names = sorted(set(langs))
        number = {x: k for k, x in enumerate(names)}
        lang = np.array([number[x] for x in langs])[text]
        words = coded.dictionary.to_pylist()
        terms, code = np.unique(lang * len(words) + coded.indices.to_numpy(), return_inverse=True)
        total = np.bincount(lang, minlength=len(names))
        code = code.astype(np.int32)
        del coded, text, broken, new, lang
        keys = [f"{names[t // len(words)]}\0{words[t % len(words)]}" for t in terms.tolist()]
        of = np.fromiter((zlib.crc32(k.encode("utf-8")) % slices for k in keys), np.int64, len(keys))
        n, places = _lists(code, at, len(keys))
        yield _rows(schema, [
            {"kind": STATE, "bucket": block, "block": block, "words": pack(np.arange(len(n)), n), "words_at": pack_lists(n, places)},
            {"kind": TOTALS, "bucket": block, "block": block, "key": names, "f": total.tolist()},
        ])
        order = np.argsort(of, kind="stable")
        yield _counts(schema, block, of[order], order, n[order], key=pa.array(keys).take(pa.array(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batched(batches, most=BLOCK_BYTES):
            texts, langs = batch.column("text"), batch.column("lang").to_pylist()
            whole = len(texts) > 1 or texts.nbytes < 2 * BLOCK_BYTES
            for part in [texts] if whole else _parts(texts):
                yield from rows_of(block, part, langs)
                block += 1
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, LEVEL)


def _counts(schema: pa.Schema, block: int, of: np.ndarray, *columns: np.ndarray, key: pa.Array | None = None) -> pa.RecordBatch:
    """One row for each slice in ``of`` (in order), with the slice's entries of the columns packed."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    cuts = np.r_[starts, len(of)].astype(np.int32)
    said = {
        "kind": pa.array(np.full(len(starts), COUNTS, np.int32)),
        "bucket": pa.array(of[starts]),
        "block": pa.array(np.full(len(starts), block)),
        "entries": pa.array([pack(*(c[i:j] for c in columns)) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()),
    }
    if key is not None:
        said["key"] = pa.ListArray.from_arrays(cuts, key)
    return pa.RecordBatch.from_arrays([said[f.name] if f.name in said else pa.nulls(len(starts), f.type) for f in schema], names=schema.names)


def frequent(level: DataFrame, least: int, slices: int) -> DataFrame:
    """Add the blocks' counts by slice: a row with the frequent phrases of each slice, and a row for each block that has some.

    An id is slice + slices times the place in the slice. A phrase is one entry a block at most,
    so slices are even whatever the phrases' frequencies.
    """
    schema = _types(KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, 1):
            bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_numpy()
            words = table.column("key").null_count == 0
            each = [unpack(x, 2 if words else 3) for x in table.column("entries").to_pylist()]
            sizes = np.array([e.shape[1] for e in each])
            entries = np.concatenate(each, axis=1)
            del each
            f = entries[-1]
            if words:
                coded = pa.concat_arrays([c.flatten() for c in table.column("key").chunks]).dictionary_encode()
            else:
                pair = [pa.array(x).dictionary_encode() for x in entries[:2]]
                wide = len(pair[1].dictionary)
                coded = pa.array(pair[0].indices.to_numpy().astype(np.int64) * wide + pair[1].indices.to_numpy()).dictionary_encode()
            code = coded.indices.to_numpy()
            total = np.bincount(code, f, len(coded.dictionary)).astype(np.int64)  # exact up to 2^53
            good = np.flatnonzero(total >= least)
            if not len(good):
                continue
            if words:
                keys = coded.dictionary.take(pa.array(good))
                order = pc.sort_indices(keys).to_numpy()
                named = {"key": keys.take(pa.array(order))}
            else:
                keys = coded.dictionary.to_numpy()[good]
                a, b = (p.dictionary.to_numpy()[k] for p, k in zip(pair, (keys // wide, keys % wide)))
                order = np.lexsort((b, a))
                named = {"a": pa.array(a[order]), "b": pa.array(b[order])}
            ids = bucket + slices * np.arange(len(good))
            place = np.full(len(total), -1)
            place[good[order]] = np.arange(len(good))
            yield _rows(schema, [{"kind": TOTALS, "bucket": bucket, "id": ids, "f": total[good[order]], **named}])
            entry = np.flatnonzero(place[code] >= 0)
            found = place[code][entry]
            of = np.repeat(np.arange(len(sizes)), sizes)[entry]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            said = [entries[0][entry], ids[found]] if words else [entries[0][entry], entries[1][entry], ids[found]]
            yield _rows(schema, [
                {"kind": COUNTS, "bucket": int(blocks[of[i]]), "entries": pack(*(c[i:j] for c in said))} for i, j in zip(starts, np.r_[starts[1:], len(of)])
            ])

    counts = level.where(F.col("kind") == COUNTS).select("bucket", "block", "entries", "key")
    return sorted_by_bucket(counts).mapInArrow(run, KEPT)


class Block:
    """The lists of one block: of the frequent words that may follow a phrase, and of the frequent phrases of ``k`` words."""

    def __init__(self, k: int, words: tuple, phrases: tuple):
        self.k = k
        self.word_ids, words_n, self.words_at = words
        self.ids, self.n, self.at = phrases
        end = int(max(self.at.max(initial=-1), self.words_at.max(initial=-1))) + k + 2
        self.words_n = words_n
        self.word_at = np.full(end, -1, np.int32)
        self.word_at[self.words_at] = np.repeat(np.arange(len(words_n), dtype=np.int32), words_n)

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase number times the number of words + number of the word) of each phrase's places that a frequent word follows.

        The last k words of the longer phrase must be frequent as a phrase too.
        """
        following = self.word_at[self.at + self.k]
        ok = following >= 0
        if self.k > 1:
            here = np.zeros(len(self.word_at), bool)
            here[self.at] = True
            ok &= here[self.at + 1]
        pair = np.repeat(np.arange(len(self.n)) * len(self.word_ids), self.n)[ok]
        pair += following[ok]
        return self.at[ok], pair

    def grown(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> Block:
        """The lists of the phrases of one more word, those with ``ids``: phrase ``a`` and word ``b``."""
        at, pair = self.extended()
        key = np.searchsorted(self.ids, a) * len(self.word_ids) + np.searchsorted(self.word_ids, b)
        order = np.argsort(key)
        key = key[order]
        found = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        ok = key[found] == pair
        by_id = np.argsort(ids)  # lists in the order of their ids
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        n, places = _lists(rank[order][found[ok]], at[ok], len(ids))
        wanted = np.zeros(len(self.word_at) + 1, bool)
        wanted[places + self.k + 1] = True
        keep = wanted[self.words_at]
        owner = np.repeat(np.arange(len(self.words_n)), self.words_n)[keep]
        left = np.bincount(owner, minlength=len(self.words_n))
        words = self.word_ids[left > 0], left[left > 0].astype(np.int32), self.words_at[keep]
        return Block(self.k + 1, words, (ids[by_id], n, places))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grow(level: DataFrame, kept: DataFrame, k: int, last: int, slices: int) -> DataFrame:
    """From the lists of ``k`` words (0: of all words) and what is frequent of one more: its lists, and counts of the next extension.

    A block's row and the frequent phrases that it has meet in one task; no other block's do. The
    lists are kept if phrases of ``last`` words need them.
    """
    schema = _types(LEVEL)
    state = ["words", "words_at", "phrases", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, 2):
            own_row = table.column("kind").to_pylist().index(STATE)
            held = {c: table.column(c)[own_row].as_py() for c in state}
            said = np.concatenate([unpack(x, 2 if k == 0 else 3) for x in table.column("entries").to_pylist() if x is not None], axis=1)
            block, ids = table.column("bucket")[0].as_py(), said[-1]
            word_ids, words_n = unpack(held["words"], 2)
            words_at = unpack_lists(words_n, held["words_at"])
            if k == 0:
                number = np.full(len(words_n), -1, np.int32)
                order = np.argsort(ids)
                number[said[0][order]] = np.arange(len(ids))
                code = np.repeat(number, words_n)
                n, places = _lists(code[code >= 0], words_at[code >= 0], len(ids))
                own = Block(1, (ids[order], n, places), (ids[order], n, places))
            else:
                words = phrase_lists = word_ids, words_n, words_at
                if held["phrases"] is not None:
                    phrase_ids, n = unpack(held["phrases"], 2)
                    phrase_lists = phrase_ids, n, unpack_lists(n, held["at"])
                own = Block(k, words, phrase_lists).grown(said[0], said[1], ids)
            kept_lists = {"words": pack(own.word_ids, own.words_n), "words_at": pack_lists(own.words_n, own.words_at)}
            kept_lists |= {"phrases": pack(own.ids, own.n), "at": pack_lists(own.n, own.at)} if own.k > 1 else {}
            if own.k + 1 < last:
                yield _rows(schema, [{"kind": STATE, "bucket": block, "block": block, **kept_lists}])
            _, pair = own.extended()
            pairs, f = np.unique(pair, return_counts=True)
            a, b = own.ids[pairs // max(len(own.word_ids), 1)], own.word_ids[pairs % max(len(own.word_ids), 1)]
            of = (_mixed(a, b) % np.uint64(slices)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            yield _counts(schema, block, of[order], a[order], b[order], f[order])
            pa.default_memory_pool().release_unused()

    none = F.lit(None).cast("binary")
    states = level.where(F.col("kind") == STATE).select("kind", "bucket", *state, none.alias("entries"))
    found = kept.where(F.col("kind") == COUNTS).select("kind", "bucket", *(none.alias(c) for c in state), "entries")
    return sorted_by_bucket(states.unionAll(found)).mapInArrow(run, LEVEL)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f, firsts), (lang, n)): frequent phrases of 1 to ``longest`` words of ``docs`` (text, lang), and all words.

    ``f`` is the exact number of occurrences, ``firsts`` are those of the phrase's first word, first
    two words and so on, itself included.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNDEFINED)).alias("lang"))
    slices = SLICES * max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    level = stash(word_lists(rows, slices), "places")
    n = level.where(F.col("kind") == TOTALS).select(F.explode(F.arrays_zip("key", "f")).alias("t"))
    n = stash(n.groupBy(F.col("t.key").alias("lang")).agg(F.sum("t.f").alias("n")), "totals")
    known: list[DataFrame] = []
    for k in range(1, longest + 1):
        kept = stash(frequent(level, least, slices), "frequent")
        listed = kept.where(F.col("kind") == TOTALS)
        if k == 1:
            each = listed.select(F.explode(F.arrays_zip("id", "key", "f")).alias("p"))
            name = F.split("p.key", "\0")
            new = each.select("p.id", name[0].alias("lang"), name[1].alias("phrase"), F.lit(1).alias("k"), "p.f", F.array("p.f").alias("firsts"))
        else:
            each = listed.select(F.explode(F.arrays_zip("id", "a", "b", "f")).alias("p")).select("p.*")
            first = known[-1].select(F.col("id").alias("a"), "lang", "phrase", "firsts")
            word = known[0].select(F.col("id").alias("b"), F.col("phrase").alias("word"))
            new = each.join(first, "a").join(word, "b").select(
                "id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(k).alias("k"), "f", F.concat("firsts", F.array("f")).alias("firsts")
            )
        known.append(stash(new, "phrases"))
        if k < longest:
            longer = stash(grow(level, kept, k - 1, longest, slices), "places")
            discard(level)
            level = longer
        discard(kept)
    discard(level)
    out = known[0]
    for more in known[1:]:
        out = out.unionAll(more)
    return out.drop("id"), n


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase with a >= ``least`` occurrences is cut after its first words into parts with l and r
    occurrences; score is floor(1000 a n / (l r)) with n words in the language, exact, of the cut
    where it is least, ties to the shortest first part. A phrase is left out where a longer one
    that holds it has ``covered`` hundredths of its occurrences or more. By score, then a, both
    falling, then phrase.

    Null and empty texts have no words, a null language is ``und``, a text of any length is read
    whole (a piece between two ends must fit into a task), repeated rows count each, an empty
    table gives an empty one. Other columns are not read.
    """
    found, n = phrases(pick(docs, text="text", lang="lang"), least, longest)
    words = F.split("phrase", " ")
    parts = F.transform(
        F.sequence(F.lit(1), F.col("k") - 1),
        lambda j: F.struct(j.alias("cut"), F.get("firsts", j - 1).alias("l"), F.array_join(F.slice(words, j + 1, F.col("k") - j), " ").alias("rest")),
    )
    cuts = found.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(parts).alias("c")).select("lang", "phrase", "a", "c.*")
    rests = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(rests, ["lang", "rest"]).join(n, "lang").withColumn(
        "score", F.expr("(1000 * cast(a as decimal(18,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    inner = F.explode(F.array(F.slice(words, 1, F.col("k") - 1), F.slice(words, 2, F.col("k") - 1)))
    longer = found.where("k > 2").select("lang", "f", inner.alias("part"))
    longer = longer.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {covered} * a")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
