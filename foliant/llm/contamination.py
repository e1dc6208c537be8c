"""Benchmark passages in training texts, found in a stored positional inverted index of the texts' words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pick, stash
from foliant.llm.words import PLAIN, batched, runs

WINDOW = 10
#: So many words of phrases are broadcast, some 100 MB at most.
BROADCAST_TERMS = 1_000_000


@dataclass(frozen=True)
class Index:
    """A stored index: ``lists`` (term, block, n, gaps) and ``docs`` (block, cuts, ids).

    A block is a batch of whole texts, whose words are numbered through; ``gaps`` are the
    differences of a term's positions in it, ``cuts`` the first word of each text and the end.
    """

    lists: DataFrame
    docs: DataFrame


def build(docs: DataFrame) -> Index:
    """Index the words of all texts of ``docs`` (doc_id, text). No row is shuffled: a block's lists are written where it is read.

    Lists are in the order of their terms within a block, so a reader that wants some terms can
    skip row groups. A block's number is the same whenever the task runs again.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["term", "block", "n", "gaps", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            block, ids = batch.column(0)[:1], batch.column("doc_id")
            coded, cuts, _ = runs(batch.column("text"), PLAIN)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.string()), block, pa.array([len(coded)], pa.int64()),
                    pa.ListArray.from_arrays(np.array([0, len(cuts)], np.int32), pa.array(cuts.astype(np.int32))),
                    pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids),
                ], names=names)
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            codes = place[coded.indices.to_numpy()]
            n = np.bincount(codes, minlength=len(order))
            at = np.argsort(codes, kind="stable").astype(np.int32)
            gaps = np.diff(at, prepend=np.int32(0))
            ends = np.cumsum(n)
            gaps[ends - n] = at[ends - n]
            cut = np.r_[0, ends].astype(np.int32)
            terms = coded.dictionary.take(pa.array(order))
            for a in range(0, len(order), 1 << 16):
                b = min(a + (1 << 16), len(order))
                lists = pa.ListArray.from_arrays(cut[a : b + 1] - cut[a], pa.array(gaps[cut[a] : cut[b]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        terms.slice(a, b - a), pa.array(np.full(b - a, block[0].as_py())), pa.array(n[a:b].astype(np.int64)), lists,
                        pa.ListArray.from_arrays(np.zeros(b - a + 1, np.int32), ids.slice(0, 0)),
                    ], names=names)

    stored = stash(rows.mapInArrow(run, f"term string, block long, n long, gaps array<int>, ids array<{kind}>"), "index")
    heads = stored.where("term is null").select("block", F.col("gaps").alias("cuts"), "ids")
    return Index(stored.where("term is not null").select("term", "block", "n", "gaps"), heads)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words) of every run of ``size`` words of the items (item_id, text); a shorter item is one, one without words none."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            coded, cuts, _ = runs(batch.column("text"), PLAIN)
            n = np.diff(cuts)
            each = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)
            of = np.repeat(np.arange(len(n)), each)
            start = cuts[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            long = np.minimum(n[of], size)
            ends = np.cumsum(long)
            at = np.repeat(start - (ends - long), long) + np.arange(int(long.sum()))
            lists = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), coded.dictionary.take(coded.indices.take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(of)), lists], names=["item_id", "words"])

    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"item_id {kind}, words array<string>").distinct()


def sub_index(index: Index, phrases: DataFrame) -> DataFrame:
    """The lists of the words of the phrases (phrase, words) alone, as a table: what a search reads of the index, once.

    The words are broadcast where they are at most BROADCAST_TERMS; beyond that lists and words
    meet in a shuffle.
    """
    asked = stash(phrases.select(F.explode("words").alias("term")).distinct(), "terms")
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return stash(index.lists.join(F.broadcast(asked) if few else asked, "term", "left_semi"), "sub-index")


def ranked_terms(lists: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, terms) of the phrases (phrase, words) of which all words are in ``lists``.

    ``terms`` are (n, offset, term) with the rarest first, by their number of occurrences in the
    whole corpus; a word that a phrase has twice is there for each offset.
    """
    each = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    n = lists.groupBy("term").agg(F.sum("n").alias("n"))
    found = each.join(n, "term").groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
    return found.where(F.size("terms") == F.col("size")).drop("size")


def _members(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``values`` the sorted array ``of`` has."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def exact(lists: dict[str, np.ndarray], cuts: np.ndarray, terms: list[dict]) -> np.ndarray:
    """Where a phrase starts: its terms' lists, each moved back by its offset, intersected from the rarest on."""
    if any(t["term"] not in lists for t in terms):
        return np.zeros(0, np.int64)
    first, *rest = sorted(terms, key=lambda t: len(lists[t["term"]]))
    starts = lists[first["term"]] - first["offset"]
    for t in rest:
        starts = starts[_members(starts + t["offset"], lists[t["term"]])]
        if not len(starts):
            return starts
    starts = starts[starts >= 0]
    whole = np.searchsorted(cuts, starts, "right") == np.searchsorted(cuts, starts + len(terms) - 1, "right")
    return starts[whole]


def near(lists: dict[str, np.ndarray], cuts: np.ndarray, terms: list[dict], within: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) word of the places where all of a phrase's terms stand among ``within`` words of a text, in any order.

    A place begins and ends with one of the terms and holds no shorter place with the same end.
    Only neighbours of the rarest term's occurrences are looked at.
    """
    names = {t["term"] for t in terms}
    if any(t not in lists for t in names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rarest, *rest = sorted((lists[t] for t in names), key=len)
    close = [rarest]
    for own in rest:
        at = np.searchsorted(rarest, own)
        after = np.where(at < len(rarest), rarest[np.minimum(at, len(rarest) - 1)] - own, within)
        before = np.where(at > 0, own - rarest[np.maximum(at - 1, 0)], within)
        close.append(own[np.minimum(after, before) < within])
    ends = np.unique(np.concatenate(close))
    starts = ends.copy()
    for own in close:  # the last occurrence up to each end
        at = np.searchsorted(own, ends, "right") - 1
        starts = np.minimum(starts, np.where(at >= 0, own[np.maximum(at, 0)], -within - 1)) if len(own) else starts - within - len(ends)
    fit = (ends - starts < within) & (starts >= 0) & (np.searchsorted(cuts, starts, "right") == np.searchsorted(cuts, ends, "right"))
    starts, ends = starts[fit], ends[fit]
    least = np.r_[True, starts[1:] != starts[:-1]] if len(starts) else np.zeros(0, bool)  # of places with one start the shortest
    return starts[least], ends[least]


def _by_block(lists: DataFrame, docs: DataFrame, ranked: DataFrame, schema: str, names: list[str], work: Callable) -> DataFrame:
    """Run ``work`` for each phrase in each block that has its rarest term.

    A block's lists of the phrases' terms meet there first, phrases stream after them, so a task
    holds the asked-for lists of one block and no more, however many the phrases.
    """
    anchors = ranked.select("phrase", "terms", F.col("terms")[0]["term"].alias("term"))
    met = lists.select("term", "block").join(anchors, "term")
    none = {
        "term": F.lit(None).cast("string"), "gaps": F.lit(None).cast("array<int>"), "phrase": F.lit(None).cast(dict(ranked.dtypes)["phrase"]),
        "terms": F.lit(None).cast(ranked.schema["terms"].dataType),
    }

    def part(rows: DataFrame, kind: int, **own: str) -> DataFrame:
        columns = (F.col(own[c]).alias(c) if c in own else v.alias(c) for c, v in none.items())
        return rows.select(F.col("block").alias("bucket"), F.lit(kind).alias("kind"), *columns)

    wanted = docs.join(met.select("block").distinct(), "block", "left_semi")
    both = part(wanted, 0, gaps="cuts").unionAll(part(lists, 1, term="term", gaps="gaps")).unionAll(part(met, 2, phrase="phrase", terms="terms"))
    ordered = both.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cuts, lists, out = None, np.zeros(0, np.int64), {}, []
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "kind", "term", "gaps", "phrase", "terms")]
            for k in range(batch.num_rows):
                block, kind = columns[0][k].as_py(), columns[1][k].as_py()
                if block != held:
                    held, cuts, lists = block, np.zeros(0, np.int64), {}
                if kind == 0:
                    cuts = columns[3][k].values.to_numpy().astype(np.int64)
                elif kind == 1:
                    lists[columns[2][k].as_py()] = np.cumsum(columns[3][k].values.to_numpy(), dtype=np.int64)
                else:
                    out.append(work(block, cuts, lists, columns[4][k].as_py(), columns[5][k].as_py()))
                    if len(out) >= 5000:
                        yield from flushed(out)
                        out = []
        yield from flushed(out)

    def flushed(out: list) -> Iterator[pa.RecordBatch]:
        rows = [r for some in out for r in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema)).types
    return ordered.mapInArrow(run, schema)


def occurrences(index: Index, phrases: DataFrame, within: int | None = None) -> DataFrame:
    """(uid, phrase, first, last) of all matches of the phrases (phrase, words) in the indexed texts.

    Without ``within`` a match is the phrase itself; with it, a place of at most so many words of
    one text that holds all words of the phrase in any order (a word counts once). ``uid`` is
    the document's number in ``documents(index)``; first and last count its words from 0.
    """
    kind = dict(phrases.dtypes)["phrase"]

    def work(block, cuts, lists, phrase, terms):
        first, last = (starts := exact(lists, cuts, terms), starts + len(terms) - 1) if within is None else near(lists, cuts, terms, within)
        doc = np.searchsorted(cuts, first, "right") - 1
        return [(block + d, phrase, a - c, b - c) for d, a, b, c in zip(doc.tolist(), first.tolist(), last.tolist(), cuts[doc].tolist())]

    names = ["uid", "phrase", "first", "last"]
    lists = sub_index(index, phrases)
    ranked = stash(ranked_terms(lists, phrases), "ranked")
    return _by_block(lists, index.docs, ranked, f"uid long, phrase {kind}, first long, last long", names, work)


def documents(index: Index) -> DataFrame:
    """(uid, doc_id, n_words) of every indexed row."""
    zipped = F.transform("ids", lambda x, i: F.struct(x.alias("doc_id"), (F.get("cuts", i + 1) - F.get("cuts", i)).cast("long").alias("n_words")))
    each = index.docs.select("block", F.posexplode(zipped).alias("at", "d"))
    return each.select((F.col("block") + F.col("at")).alias("uid"), "d.doc_id", "d.n_words")


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    n_hit: words of the document inside any occurrence of a window of ``size`` words of an item;
    n_items: items with such windows; items_sha256: of their identifiers, sorted as strings and
    joined by commas (of nothing where there are none).

    Null and empty texts have no words, and items without words no window; a null item_id is an
    empty one. Rows that repeat an identifier are rows of their own; equal windows of several
    items count for all of them. An empty table of either kind gives no hits. Words are runs of
    letters, digits and characters beyond ASCII, A-Z in lower case; other columns are not read.
    """
    index = build(pick(docs, doc_id="doc_id", text="text"))
    named = pick(items, item_id="item_id", text="text").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    own = stash(windows(named, size).withColumn("phrase", F.array_join("words", " ")), "windows")
    found = stash(occurrences(index, own.select("phrase", "words").distinct()), "occurrences")
    # the words of a document that some match covers: its matches in order, each counted from where the last one ended
    spans = found.select("uid", "first", "last").distinct()
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("first", "last"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["last"] - F.greatest(x["first"] - 1, s["end"]), F.lit(0))).alias("n"), F.greatest(x["last"], s["end"]).alias("end")
        ),
        lambda s: s["n"],
    )
    hit = spans.groupBy("uid").agg(covered.alias("n_hit"))
    pairs = found.select("uid", "phrase").distinct().join(own.select("phrase", "item_id"), "phrase").select("uid", "item_id").distinct()
    which = pairs.groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    rows = documents(index).join(hit, "uid", "left").join(which, "uid", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
