"""Mixture-controlled packing: deficit round-robin over source queues into windows of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pick, stash
from foliant.llm.words import batched, gather, split

WINDOW = 2048
#: Queues of one round-robin; more are served by round-robins within round-robins.
FAN = 1024
#: Fractions of a token that quanta are counted in.
FINE = 1 << 16
#: (round, queue) cells that a task computes at a time.
CELLS = 1 << 18
#: Tokens whose pieces are dealt at a time; a longer document comes alone.
TOKENS = 1 << 20
#: Stands for a null source.
NO_SOURCE = "\0null"
END_OF_TEXT = "<|endoftext|>"
#: Unicode white space, as the pre-tokenizer's \s has it, for a character class.
SPACE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts in which a space is not one space between two other characters, or with a special token.
ODD = f"^ | $|[{SPACE}] | [{SPACE}]|<\\|endoftext\\|>"
#: Fixed value: the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of whole texts by a byte-level BPE vocabulary file.

    The pre-tokenizer never joins a non-space with a space after it. So where single spaces
    stand between words, a text's ids are those of its first word and of each later word with
    its space. The distinct words of a batch are encoded together, once; other texts are
    encoded whole.
    """

    def __init__(self, vocabulary: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_alphabet()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t != END_OF_TEXT}
        coding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = coding.encode_to_numpy
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        self.largest = max(model["vocab"].values())

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words that each follow a space: they are encoded as one text and cut apart."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        ids = self.encode(" " + " ".join(words), disallowed_special=())
        ends = np.cumsum(self.width[ids])
        edges = np.cumsum([len(w.encode("utf-8")) + 1 for w in words])
        return ids.astype(np.uint32), np.r_[0, np.searchsorted(ends, edges) + 1]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) | (
            pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        )
        plain = texts.filter(pa.array(~odd))
        words, codes, offsets = split(plain)
        flat, cuts = self.words(words)
        first = [np.asarray(self.encode(words[c], disallowed_special=()), np.uint32) for c in codes[offsets[:-1]].tolist()]
        rest = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes = np.fromiter(map(len, first), np.int64, len(first))
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(words) + np.arange(len(first))
        starts = np.r_[cuts[:-1], len(flat) + np.cumsum(sizes) - sizes]
        ids, ends = gather(np.concatenate([flat, *first]), starts, np.r_[np.diff(cuts), sizes], codes)
        ends = np.r_[0, ends][offsets]
        if not rest:
            return ids, ends
        parts = np.empty(len(texts), object)
        parts[np.flatnonzero(~odd)] = _views(ids, ends)
        parts[np.flatnonzero(odd)] = _views(np.concatenate(rest), np.r_[0, np.cumsum([len(r) for r in rest])])
        return np.concatenate(parts.tolist()), np.r_[0, np.cumsum([len(p) for p in parts])]


def _views(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(ends) - 1, object)
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        out[k] = ids[a:b]
    return out


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, ByteBpe] = {}


def encoder(vocabulary: str) -> ByteBpe:
    """The worker's encoder."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ByteBpe(vocabulary)
    return _encoders[vocabulary]


def tokenise(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """(doc_id, source, part, before, n, ids) of (doc_id, source, text).

    part is the task; before counts the tokens of the same source in that task before the row.
    ids are little-endian, with ``end`` after the text's own, of 16 bits if all of the
    vocabulary fit, else of 32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, sums = encoder(vocabulary), TaskContext.get().partitionId(), {}
        narrow = np.uint16 if max(enc.largest, end) < 1 << 16 else np.uint32
        for some in batched(batches):
            flat, cuts = enc.batch(some.column("text"))
            flat = np.insert(flat.astype(narrow), cuts[1:], end)
            cuts = cuts + np.arange(len(cuts))
            n, before = np.diff(cuts), []
            for source, k in zip(some.column("source").to_pylist(), n.tolist()):
                before.append(sums.get(source, 0))
                sums[source] = before[-1] + k
            ids = pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((flat.itemsize * cuts).astype(np.int32)), pa.py_buffer(flat)]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    some.column("source"),
                    pa.array([part] * len(n), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array(n, pa.int64()),
                    ids,
                ],
                names=["doc_id", "source", "part", "before", "n", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInArrow(
        run, f"doc_id {kind}, source string, part int, before long, n long, ids binary"
    )


class RoundRobin:
    """Deficit round-robin over queues of known length, in closed form.

    In each round a queue earns its quantum, a share of the window, and sends whole tokens;
    the fraction left is its deficit, which it carries on. After r rounds queue q has sent
    min(total, r * quantum // FINE) tokens, so any task can tell where any round of any queue
    begins in the stream of all rounds without the rounds before it. A queue that is empty
    sends nothing, and the next round begins sooner; windows stay full.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int):
        total = sum(w for w, t in zip(weights, totals) if t) or 1
        self.totals = np.array(totals, np.int64)
        self.quanta = np.array([max(1, int(window * FINE * w / total)) for w in weights], np.int64)
        #: Rounds after which a queue is empty.
        self.finish = (self.totals * FINE + self.quanta - 1) // self.quanta

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """(round, queue): tokens sent before each round."""
        return np.minimum(self.totals, np.minimum(rounds[:, None], self.finish) * self.quanta // FINE)

    def round_of(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The round that sends this token of the queue."""
        quantum = int(self.quanta[queue])
        return ((token + 1) * FINE + quantum - 1) // quantum - 1

    def pieces(self, queue: int, start: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token in queue, place in the stream, length) of the pieces of n tokens from ``start``."""
        return self.runs(queue, np.array([start], np.int64), np.array([n], np.int64))[1:]

    def runs(self, queue: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(run, token in queue, place in the stream, length) of the pieces of several runs of tokens.

        Only rounds that send one of these tokens are looked at, ``CELLS`` (round, queue) pairs at a time.
        """
        dense = int(self.quanta[queue]) >= FINE  # else a round sends one token at most, and most rounds send none
        first = self.round_of(queue, start) if dense else start
        count = self.round_of(queue, start + n - 1) - first + 1 if dense else n
        ends = np.cumsum(count)
        most = max(1, CELLS // len(self.totals))
        got = []
        for at in range(0, int(ends[-1]), most):
            unit = np.arange(at, min(at + most, int(ends[-1])))
            run = np.searchsorted(ends, unit, side="right")
            unit = first[run] + unit - (ends - count)[run]
            rounds = unit if dense else self.round_of(queue, unit)
            sent, then = self.sent(rounds), self.sent(rounds + 1)
            place = then[:, :queue].sum(axis=1) + sent[:, queue:].sum(axis=1)
            begin, stop = np.maximum(sent[:, queue], start[run]), np.minimum(then[:, queue], (start + n)[run])
            full = stop > begin
            got.append((run[full], begin[full], (place + begin - sent[:, queue])[full], (stop - begin)[full]))
        return tuple(map(np.concatenate, zip(*got)))


class Mixture:
    """Any number of queues in deficit round-robin; those without a target follow after all others, one by one.

    More than ``fan`` queues with targets form groups of neighbours: a group is a queue of the
    round-robin above, which shares the window by the groups' sums, and a round-robin of its
    own whose round is what the group gets of a window. So each queue holds its target, and a
    token costs ``fan`` cells a level.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int, fan: int = FAN):
        self.place: dict[int, tuple[int, int]] = {}  # queue: its group and its number there
        self.after: dict[int, int] = {}
        served = [q for q, (t, w) in enumerate(zip(totals, weights)) if t and w > 0]
        groups = [served[at : at + fan] for at in range(0, len(served), fan)]
        sums = [(sum(totals[q] for q in g), sum(weights[q] for q in g)) for g in groups]
        whole = sum(w for _, w in sums) or 1
        self.groups = []
        for k, (g, (_, share)) in enumerate(zip(groups, sums)):
            self.place |= {q: (k, j) for j, q in enumerate(g)}
            round_of_group = max(1, int(window * share / whole))
            self.groups.append(RoundRobin([totals[q] for q in g], [weights[q] for q in g], round_of_group))
        self.above = Mixture([t for t, _ in sums], [w for _, w in sums], window, fan) if len(groups) > 1 else None
        at = sum(t for t, _ in sums)
        for q, t in enumerate(totals):
            if q not in self.place:
                self.after[q] = at
                at += t

    def runs(self, queue: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """As of ``RoundRobin``."""
        if queue in self.after:
            return np.arange(len(start)), start, self.after[queue] + start, n
        group, number = self.place[queue]
        run, begin, place, length = self.groups[group].runs(number, start, n)
        if self.above is None:
            return run, begin, place, length
        upper, inner, place, length = self.above.runs(group, place, length)
        ends = np.cumsum(length)  # runs of the group's stream, cut further but in the same order
        first = np.r_[True, upper[1:] != upper[:-1]]
        base = np.maximum.accumulate(np.where(first, ends - length, 0))
        return run[upper], begin[upper] + ends - length - base, place, length

    def pieces(self, queue: int, start: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of ``RoundRobin``."""
        return self.runs(queue, np.array([start], np.int64), np.array([n], np.int64))[1:]


def cut_at(
    window: int, begin: np.ndarray, place: np.ndarray, length: np.ndarray, row: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """The same pieces, cut where a window ends; with ``row``, first the row of each piece."""
    count = (place + length - 1) // window - place // window + 1
    of = np.repeat(np.arange(len(place)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    cut = np.maximum(place[of], (place[of] // window + number) * window)
    stop = np.minimum((place + length)[of], (cut // window + 1) * window)
    got = begin[of] + cut - place[of], cut, stop - cut
    return got if row is None else (row[of], *got)


def pack(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    window: int = WINDOW,
    end: int = 1,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Pack the tokens of all documents into windows that each hold the sources in target proportions.

    Returns per piece: doc_id, start (the document's tokens before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, source, sequence_id, offset. All windows are
    full but the last; each token of each document is in exactly one piece.

    ``weights`` are target shares by source (None for a null source); without them a source's
    share is its share of all tokens. Sources that ``weights`` leaves out or gives nothing
    follow after all others. Every source has a queue; a row a source goes through the driver.
    A null text is empty, a null source a source of its own, and a document without
    text still has its end token. Rows that repeat a doc_id are packed each. An empty table
    gives no pieces. Other columns are not read and may have any name.
    """
    own = pick(docs, doc_id=doc_id, source=source, text=text)
    own = own.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    rows = stash(tokenise(own, vocabulary, end), "tokens")
    parts = stash(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "queues")
    by_source = parts.groupBy("source").agg(F.sum("n").alias("total"))
    sources = by_source.orderBy(F.desc("total"), "source").collect()
    totals = [r["total"] for r in sources]
    names = [None if r["source"] == NO_SOURCE else r["source"] for r in sources]
    turns = Mixture(totals, [float(t) for t in totals] if weights is None else [weights.get(s, 0.0) for s in names], window)

    # where each task's tokens of a queue begin: sums over the tasks before it
    spark = docs.sparkSession
    queues = spark.createDataFrame([(r["source"], i) for i, r in enumerate(sources)], "source string, queue int")
    starts = stash(_running(parts.join(queues, "source")), "starts")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            at = 0
            while at < batch.num_rows:  # some tokens at a time, whatever the rows' lengths
                before = int(ends[at - 1]) if at else 0
                stop = min(max(at + 1, int(np.searchsorted(ends, before + TOKENS, side="right"))), at + 256)
                some, at = batch.slice(at, stop - at), stop
                queue, base, before, n = (some.column(c).to_numpy() for c in ("queue", "base", "before", "n"))
                rows, starts, places, lengths = [], [], [], []
                for q in np.unique(queue).tolist():
                    mine = np.flatnonzero(queue == q)
                    run, begin, place, length = turns.runs(q, (base + before)[mine], n[mine])
                    rows.append(mine[run])
                    starts.append(begin - (base + before)[mine][run])
                    places.append(place)
                    lengths.append(length)
                row, start, place, length = cut_at(window, *map(np.concatenate, (starts, places, lengths)), np.concatenate(rows))
                order = np.lexsort((start, row))
                row, start, place, length = row[order], start[order], place[order], length[order]
                held = b"".join(some.column("ids").to_pylist())
                flat = np.frombuffer(held, np.uint16 if len(held) == 2 * n.sum() else np.uint32).astype("<u4")
                ids, stops = gather(flat, (np.cumsum(n) - n)[row] + start, length, np.arange(len(row)))
                pieces = pa.Array.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(np.r_[0, 4 * stops].astype(np.int32)), pa.py_buffer(ids)]
                )
                take = pa.array(row)
                name = some.column("source").take(take)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(take),
                        pa.array(start),
                        pa.array(length),
                        pieces,
                        some.column("n").take(take),
                        pc.if_else(pc.equal(name, NO_SOURCE), pa.scalar(None, pa.string()), name),
                        pa.array(place // window),
                        pa.array(place % window),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "source", "sequence_id", "offset"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return (
        rows.join(starts, ["source", "part"])
        .select("doc_id", "source", "queue", "base", "before", "n", "ids")
        .mapInArrow(
            deal,
            f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, source string, "
            "sequence_id long, offset long",
        )
    )


def _running(parts: DataFrame, group: int = 1024) -> DataFrame:
    """(source, part, queue, base): tokens of the queue before each (source, part), in two levels.

    Blocks of ``group`` parts are summed first, so no task sees more than a block's rows or a
    queue's blocks.
    """
    from pyspark.sql import Window

    blocks = parts.withColumn("block", F.floor(F.col("part") / group))
    sums = blocks.groupBy("queue", "block").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("queue", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("above"))
    inside = Window.partitionBy("queue", "block").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return inner.join(sums, ["queue", "block"]).select(
        "source", "part", "queue", (F.col("above") + F.col("within")).alias("base")
    )


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of ``pack``."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "source",
    )
