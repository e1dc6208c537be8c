"""Importance resampling towards a target corpus, over postings of hashed features that are partitioned by bucket."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import pick, stash
from foliant.llm.groups import salted_join
from foliant.llm.words import PLAIN, batched, runs

BUCKETS = 10_000
#: A hashed feature is a run of 1 to so many words.
LONGEST = 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: The row of a block that has its documents instead of a bucket's postings.
HEADER = -1


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a batch, and the number of words of each text."""
    coded, cuts, _ = runs(texts, PLAIN)
    words = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
    own = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(cuts))
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(own))  # words to the text's end
    of, out = [], []
    codes, names = own, words
    for n in range(1, longest + 1):
        if n > 1:
            here = np.flatnonzero(left >= n)
            pairs, codes_here = np.unique(codes[here] * len(words) + own[here + n - 1], return_inverse=True)
            names = [names[p // len(words)] + b" " + words[p % len(words)] for p in pairs.tolist()]
            codes = np.zeros(len(own), np.int64)
            codes[here] = codes_here
        else:
            here = np.arange(len(own))
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int64, len(names))
        of.append(text[here])
        out.append(bucket[codes[here]])
    return np.concatenate(of), np.concatenate(out), np.diff(cuts)


def postings(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Inverted lists of ``docs`` (doc_id, text) by block of documents: (bucket, block, at, n, total, ids).

    ``at`` are places of documents from the block's first on, ``n`` the counts of the bucket in
    them. The row HEADER has all documents of its block, their words and identifiers. A block
    is a batch of whole texts; its number, and so a document's number block + at, is the same
    whenever the task runs again.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["bucket", "block", "at", "n", "total", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            size, base = batch.num_rows, batch.column(0)[0].as_py()
            text, bucket, words = features(batch.column("text"), longest, buckets)
            pairs, n = np.unique(bucket * size + text, return_counts=True)
            bucket, at = pairs // size, pairs % size
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            cuts = np.r_[0, starts + size, len(pairs) + size].astype(np.int32)  # the header comes first
            total = np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64)
            ids = batch.column("doc_id")
            lists = pa.ListArray.from_arrays(np.r_[0, np.full(len(starts) + 1, size)].astype(np.int32), ids)
            columns = [
                pa.array(np.r_[HEADER, bucket[starts]].astype(np.int32)),
                pa.array(np.full(len(starts) + 1, base)),
                pa.ListArray.from_arrays(cuts, pa.array(np.r_[np.arange(size), at].astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(np.r_[words, n].astype(np.int32))),
                pa.array(np.r_[0, total].astype(np.int64)),
                lists,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"bucket int, block long, at array<int>, n array<int>, total long, ids array<{kind}>")


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from the postings of both corpora, grouped together by bucket: at most ``buckets`` rows.

    gain: floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) with s and t features of
    the bucket, S and T all. Counts are combined before they move.
    """
    both = docs.select("bucket", F.col("total").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(
        target.select("bucket", F.lit(0).cast("long"), "total")
    )
    per = both.where(F.col("bucket") != HEADER).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = per.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row

    def real(c: str, more: int) -> Column:
        return (F.col(c) + more).cast("double")

    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return per.join(F.broadcast(whole), how="cross").select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def weights(own: DataFrame, gain: DataFrame) -> DataFrame:
    """(uid, weight_sum): each posting's count times its bucket's gain, added by document.

    Postings and gains meet by bucket; a frequent bucket's blocks are spread over several tasks.
    What a task emits is added by document before it moves.
    """
    lists = own.where(F.col("bucket") != HEADER).select("bucket", "block", "at", "n")
    met = salted_join(lists, gain, ["bucket"], "block")
    each = met.select("block", "gain", F.explode(F.arrays_zip("at", "n")).alias("p"))
    return each.groupBy((F.col("block") + F.col("p.at")).alias("uid")).agg(F.sum(F.col("p.n") * F.col("gain")).alias("weight_sum"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (uid, doc_id, n_words, score, ...) with ``rank`` of the drawn rows, null of all others.

    Scores are integers in a range of some 10^5 at any number of rows (logarithms times 1000), so
    the count of each score is a small table: it gives the first rank of each score, and only
    rows of one score are sorted together. Ties go to the smaller doc_id, null ones last.
    """
    fit = scored.where(F.col("n_words") >= least_words)
    counts = fit.groupBy("score").agg(F.count("*").alias("rows"))
    falling = Window.orderBy(F.desc("score"))
    before = F.sum("rows").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    quota = F.floor(F.sum("rows").over(Window.partitionBy()) * percent / 100)
    firsts = counts.select("score", F.coalesce(before, F.lit(0)).alias("before"), quota.alias("quota")).where("before < quota")
    met = fit.join(F.broadcast(firsts), "score")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "uid"))
    drawn = met.select("uid", "quota", (F.col("before") + place).alias("rank")).where("rank <= quota").drop("quota")
    return scored.join(drawn, "uid", "left")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``, drawn towards ``target`` (text).

    weight: the floored mean of the gains of a document's features; 0 without features. score:
    weight plus Gumbel noise from the hash of seed and doc_id, so the highest scores are a
    draw without replacement in proportion to exp(weight / 1000). rank: 1, 2, ... of the drawn
    floor(percent / 100 of the rows with ``least_words`` words or more), else null.

    Null and empty texts have no features. Rows that repeat a doc_id are rows of their own; a null
    doc_id is hashed as an empty one and loses ties. An empty table gives an empty one; an
    empty target makes every feature's gain its rarity. Other columns are not read.
    """
    own = stash(postings(pick(docs, doc_id="doc_id", text="text"), longest, buckets), "postings")
    other = postings(pick(target, text="text").select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    sums = weights(own, gains(own, other, buckets))
    each = own.where(F.col("bucket") == HEADER).select("block", F.explode(F.arrays_zip("at", "n", "ids")).alias("p"))
    n_features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(longest)), F.lit(0))
    rows = each.select(
        (F.col("block") + F.col("p.at")).alias("uid"), F.col("p.ids").alias("doc_id"), F.col("p.n").cast("long").alias("n_words")
    ).withColumn("n_features", n_features.cast("long"))
    total, n = F.coalesce("weight_sum", F.lit(0)), F.col("n_features")
    weight = F.when(n > 0, F.expr("(weight_sum - pmod(weight_sum, n_features)) div n_features")).otherwise(F.lit(0))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)
    scored = rows.join(sums, "uid", "left").withColumn("weight_sum", total).withColumn("weight", weight)
    scored = stash(scored.withColumn("score", F.col("weight") + noise).drop("weight_sum"), "scored")
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
