"""A kept full-text index: positional postings by term in blocks with bounds, changed by books, searched without the texts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.functions.lists import WORDS, gathered, sizes, slices
from foliant.functions.text import tokens
from foliant.operators.retrieval import EPSILON, K1, B, Tokenizer, of_books, query_tokens

#: Folders of terms, postings of a block, and postings of a term that are numbered together.
FOLDERS, BLOCK, SHARE = 64, 128, 100_000
#: Words whose postings are a slot, a share of a folder, and slots of a task: what a task holds doesn't grow with the index.
SLOT, SLOTS = 200_000, 2
#: Words that a task gathers at a time.
TOKENS = WORDS
#: What a list is ordered by, the most telling first; a search's bounds don't depend on it.
USUAL_LENGTH = 100.0


@dataclass(frozen=True)
class TextIndex:
    """Tables under ``path``: postings (by folder of terms), documents (id, book_id, doc_len, terms), terms (term, df), stats (one row).

    Each change writes a new generation of what it adds and then names it in ``state``; a search
    of an older state reads what it read before. ``gone`` has the ids that a change took away:
    rows of generations ``before`` it don't count.
    """

    spark: SparkSession
    path: str
    state: dict

    def table(self, name: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{name}/generation={g}").withColumn("generation", F.lit(g)) for g in self.state[name]]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def schema(self) -> StructType:
        """Of the postings, also of a generation that has none."""
        kinds = dict(self.spark.read.parquet(f"{self.path}/documents/generation={self.state['documents'][0]}").dtypes)
        posting = f"struct<id: {kinds['id']}, book_id: {kinds['book_id']}, doc_len: int, tf: int, positions: array<int>>"
        return StructType.fromDDL(f"term string, part int, block int, most_tf int, least_len int, n long, postings array<{posting}>, folder int")

    def stats(self) -> dict:
        return self.table("stats").first().asDict()


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _commit(spark: SparkSession, path: str, state: dict) -> TextIndex:
    """Name a state: one small file, written last."""
    number = max(max(v) for v in state.values())
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state/{number}")
    return TextIndex(spark, path, state)


def load(spark: SparkSession, path: str) -> TextIndex:
    """The newest state that was committed."""
    rows = spark.read.option("recursiveFileLookup", "true").schema("state string").json(f"{path}/state").collect()  # one row a change
    return TextIndex(spark, path, max((json.loads(r["state"]) for r in rows), key=lambda s: max(max(v) for v in s.values())))


def _positions(chunks: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(id, book_id, doc_len, term, positions) of every term of every chunk, gathered where the chunk is: nothing is shuffled yet."""
    split = chunks.select("id", "book_id", tokenizer(F.col("content")).alias("tokens"))
    out = StructType([split.schema["id"], split.schema["book_id"], *StructType.fromDDL("doc_len int, term string, positions array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "tokens", TOKENS)):
            tokens = batch.column("tokens")
            row, term, starts, places = gathered(tokens)
            held = [batch.column(c).take(pa.array(row)) for c in ("id", "book_id")]
            positions = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*held, pa.array(sizes(tokens)[row], pa.int32()), term, positions], names=out.fieldNames())

    return split.mapInArrow(run, out)


def _blocks(postings: DataFrame, counts: DataFrame, words: int = 0) -> DataFrame:
    """Postings of each term in blocks of BLOCK, with what bounds their scores: the greatest tf and the least length.

    The most telling postings come first. A term with many postings, by ``counts`` (term, n), is numbered in as many
    parts as SHARE asks for, so no term is one task's; those terms are few and are broadcast. Postings are shuffled once,
    by folder and slot; ``words``, the number of all, says how many slots a folder has.
    """
    slots = max(-(-words // (FOLDERS * SLOT)), 1)
    parts = counts.select("term", F.ceil(F.col("n") / SHARE).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int")
    cut = postings.join(F.broadcast(parts), "term", "left").withColumn("part", part).drop("parts").withColumn("folder", folder(F.col("term")))
    key = F.xxhash64("term", "part")
    cut = cut.withColumn("slot", F.pmod(key, F.lit(slots)).cast("int")).repartition(FOLDERS * max(slots // SLOTS, 1), "folder", "slot")
    cut = cut.withColumn("key", key).withColumn("tf", F.size("positions"))
    impact = F.col("tf") / (F.col("tf") + K1 * (1.0 - B + B * F.col("doc_len") / USUAL_LENGTH))
    # grouped by folder and slot too, so that Spark knows that the rows are where they must be; by key first, as sorts compare its number before all else
    place = F.row_number().over(Window.partitionBy("key", "folder", "slot", "part", "term").orderBy(F.desc(impact), "id")) - 1
    posting = F.struct("id", "book_id", "doc_len", "tf", "positions")
    return (
        cut.withColumn("block", F.floor(place / BLOCK).cast("int"))
        .groupBy("key", "folder", "slot", "part", "term", "block")
        .agg(
            F.max("tf").alias("most_tf"),
            F.min("doc_len").alias("least_len"),
            F.count("*").alias("n"),
            F.sort_array(F.collect_list(posting)).alias("postings"),  # at most BLOCK
        )
    )


def _write_postings(chunks: DataFrame, path: str, generation: int, tokenizer: Tokenizer) -> None:
    """The postings of chunks whose documents are written."""
    documents = chunks.sparkSession.read.parquet(f"{path}/documents/generation={generation}")
    counts = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rows = _blocks(_positions(chunks, tokenizer), counts, _size(documents)[1])
    # by term within a folder, so that a search reads the row groups of its terms alone
    rows = rows.select("term", "part", "block", "most_tf", "least_len", "n", "postings", "folder").sortWithinPartitions("folder", "term", "part", "block")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/postings/generation={generation}")


def _write_documents(chunks: DataFrame, path: str, generation: int, tokenizer: Tokenizer) -> None:
    split = chunks.select("id", "book_id", tokenizer(F.col("content")).alias("tokens"))
    rows = split.select("id", "book_id", F.size("tokens").alias("doc_len"), F.array_distinct("tokens").alias("terms"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents/generation={generation}")


def _size(documents: DataFrame) -> tuple[int, int]:
    """(documents, words of all)."""
    return tuple(documents.agg(F.count("*"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0))).first())


def _write_stats(spark: SparkSession, path: str, generation: int, n: int, words: int, terms: DataFrame) -> None:
    """The number of documents, their average length and the floor of the inverse document frequencies.

    The average over all terms needs the number of terms of each df alone.
    """
    by_df = terms.groupBy("df").agg(F.count("*").alias("terms"))
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = (F.sum(idf * F.col("terms")) / F.sum("terms") * EPSILON).alias("floor")
    all_words, mean = F.lit(words).cast("long").alias("words"), F.lit(words / n if n else 1.0).alias("avgdl")
    by_df.agg(floor).select(F.lit(n).cast("long").alias("n"), all_words, mean, "floor").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/generation={generation}")


def build(chunks: DataFrame, path: str, tokenizer: Tokenizer = tokens) -> TextIndex:
    """Index chunks (id, book_id, content) under a new ``path``."""
    spark = chunks.sparkSession
    _write_documents(chunks, path, 0, tokenizer)
    _write_postings(chunks, path, 0, tokenizer)
    first = TextIndex(spark, path, {"postings": [0], "documents": [0], "terms": [0], "stats": [0], "gone": [0]})
    spark.createDataFrame([], "id string, before int").write.mode("overwrite").parquet(f"{path}/gone/generation=0")
    postings = spark.read.schema(first.schema()).parquet(f"{path}/postings/generation=0")
    counts = postings.groupBy("term").agg(F.sum("n").alias("df"))
    counts.write.mode("overwrite").parquet(f"{path}/terms/generation=0")
    _write_stats(spark, path, 0, *_size(first.table("documents")), first.table("terms"))
    return _commit(spark, path, first.state)


def replace_books(index: TextIndex, chunks: DataFrame, book_ids: Sequence[str], tokenizer: Tokenizer = tokens) -> TextIndex:
    """The index after all chunks of these books were replaced by ``chunks`` (which may be none).

    Only the new chunks are read. Old postings stay where they are and are passed over by the
    ids that are gone; frequencies change by the terms of the chunks that come and go.
    """
    spark, path, state, stats = index.spark, index.path, index.state, index.stats()
    new = max(max(v) for v in state.values()) + 1
    old = _live(index, index.table("documents"), book_ids) if book_ids else index.table("documents").limit(0)
    _write_documents(chunks, path, new, tokenizer)
    _write_postings(chunks, path, new, tokenizer)
    gone = old.select(F.col("id").cast("string").alias("id"), F.lit(new).alias("before"))
    gone.write.mode("overwrite").parquet(f"{path}/gone/generation={new}")
    added = spark.read.parquet(f"{path}/documents/generation={new}")
    change = old.select(F.explode("terms").alias("term"), F.lit(-1).alias("df")).unionAll(added.select(F.explode("terms"), F.lit(1)))
    terms = index.table("terms").select("term", "df").unionByName(change)
    terms = terms.groupBy("term").agg(F.sum("df").cast("long").alias("df")).where("df > 0")
    terms.write.mode("overwrite").parquet(f"{path}/terms/generation={new}")
    (less, fewer), (more, longer) = _size(old), _size(added)
    _write_stats(spark, path, new, stats["n"] - less + more, stats["words"] - fewer + longer, spark.read.parquet(f"{path}/terms/generation={new}"))
    grown = {name: [*state[name], new] for name in ("postings", "documents", "gone")}
    return _commit(spark, path, grown | {"terms": [new], "stats": [new]})


def _lists(index: TextIndex, asked: Sequence[str]) -> DataFrame:
    """The blocks of the asked-for terms, with their generation: folders and row groups of other terms are not read."""
    spark, rows = index.spark, []
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "term string").select(folder(F.col("term"))).distinct().collect()]
    for g in index.state["postings"]:
        part = spark.read.schema(index.schema()).parquet(f"{index.path}/postings/generation={g}")
        rows.append(part.where(F.col("folder").isin(*folders) & F.col("term").isin(*asked)).withColumn("generation", F.lit(g)))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _live(index: TextIndex, postings: DataFrame, book_ids: Sequence[str] | None) -> DataFrame:
    """Single postings or documents without those of chunks that went after they were written."""
    out = of_books(postings, book_ids)
    gone = index.table("gone").drop("generation").groupBy(F.col("id").alias("gone_id")).agg(F.max("before").alias("before"))
    if len(index.state["gone"]) > 1:
        out = out.join(gone, (F.col("id").cast("string") == F.col("gone_id")) & (F.col("generation") < F.col("before")), "left_anti")
    return out


def _asked(index: TextIndex, query: str, tokenizer: Tokenizer) -> list[dict]:
    """The query's terms that the index has, with times and idf: as many rows as the query has words."""
    words = query_tokens(index.spark, query, tokenizer).collect()
    if not words:
        return []
    stats = index.stats()
    df = index.table("terms").where(F.col("term").isin(*(w["term"] for w in words)))
    idf = F.log(F.lit(float(stats["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    found = {r["term"]: r["idf"] for r in df.select("term", F.when(idf < 0, F.lit(stats["floor"])).otherwise(idf).alias("idf")).collect()}
    return [{"term": w["term"], "times": w["times"], "idf": found[w["term"]]} for w in words if w["term"] in found]


def _gain(tf: Column, doc_len: Column, avgdl: float) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1.0) / (tf + K1 * (F.lit(1.0 - B) + B * doc_len.cast("double") / F.lit(avgdl)))


def scores(index: TextIndex, query: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(id, raw) of every chunk with a term of the query: the rows of ``bm25_scores`` over the same chunks, from the postings alone."""
    asked = _asked(index, query, tokenizer)
    lists = _lists(index, [a["term"] for a in asked] or [""]).select("term", "generation", F.explode("postings").alias("p"))
    live = _live(index, lists.select("term", "generation", "p.*"), None)
    return _summed(index, live, asked)


def _summed(index: TextIndex, live: DataFrame, asked: list[dict]) -> DataFrame:
    terms = index.spark.createDataFrame([(a["term"], a["times"] * a["idf"]) for a in asked], "term string, weight double")
    part = F.col("weight") * _gain(F.col("tf"), F.col("doc_len"), index.stats()["avgdl"])
    # added by term, so that equal chunks have equal scores to the last bit; a chunk has a row a term of the query
    parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
    return live.join(F.broadcast(terms), "term").groupBy("id").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]).alias("raw"))


def topk(index: TextIndex, query: str, k: int = 10, book_ids: Sequence[str] | None = None, tokenizer: Tokenizer = tokens) -> DataFrame:
    """The k best chunks (id, raw) of these books by BM25 over the whole index, ties by id; blocks that can't reach the k-th score are not read.

    A chunk's score is at least what one term gives it, so the k-th best single contribution of
    the best blocks is a floor of the k-th score. A block whose bound for its term, with the
    greatest bounds of all other terms, is below that floor is left out: none of its chunks
    can be among the k, and those that are have all their blocks. With weights below zero nothing
    is left out.
    """
    asked = _asked(index, query, tokenizer)
    lists = _lists(index, [a["term"] for a in asked] or [""])
    if asked and min(a["idf"] for a in asked) >= 0:
        lists = lists.join(F.broadcast(wanted_blocks(index, lists, asked, k, book_ids)), ["term", "generation", "part", "block"], "left_semi")
    each = lists.select("term", "generation", F.explode("postings").alias("p"))
    best = _summed(index, _live(index, each.select("term", "generation", "p.*"), book_ids), asked)
    return best.orderBy(F.desc("raw"), "id").limit(k)


def wanted_blocks(index: TextIndex, lists: DataFrame, asked: list[dict], k: int, book_ids: Sequence[str] | None) -> DataFrame:
    """(term, generation, part, block) of the blocks that may hold one of the k best; only bounds are read, and the postings of the first blocks."""
    avgdl = index.stats()["avgdl"]
    terms = index.spark.createDataFrame([(a["term"], a["times"] * a["idf"]) for a in asked], "term string, weight double")
    bounds = lists.select("term", "generation", "part", "block", "most_tf", "least_len").join(F.broadcast(terms), "term")
    bounds = bounds.withColumn("bound", F.col("weight") * _gain(F.col("most_tf"), F.col("least_len"), avgdl))
    first = lists.where("block = 0").select("term", "generation", F.explode("postings").alias("p")).select("term", "generation", "p.*")
    single = _live(index, first, book_ids).join(F.broadcast(terms), "term").withColumn("own", F.col("weight") * _gain(F.col("tf"), F.col("doc_len"), avgdl))
    kth = [r["own"] for r in single.groupBy("id").agg(F.max("own").alias("own")).orderBy(F.desc("own")).limit(k).collect()]
    floor = kth[-1] if len(kth) == k else float("-inf")
    greatest = {r["term"]: r["bound"] for r in bounds.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
    total = sum(greatest.values())
    rest = index.spark.createDataFrame([(t, total - b) for t, b in greatest.items()], "term string, others double")
    reach = bounds.join(F.broadcast(rest), "term").where((F.col("bound") + F.col("others")) * (1 + 1e-9) >= floor)
    return reach.select("term", "generation", "part", "block")


def near(index: TextIndex, query: str, k: int = 20, book_ids: Sequence[str] | None = None, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(id, raw, span): the k chunks that hold all words of the query closest together, from the positions alone.

    span is the number of words of the shortest stretch with all m distinct words of the query, raw
    is m / span: 1 where they are neighbours in any order. Ties go to the greater number of
    occurrences, then by id. A query without words has no hits.
    """
    words = [r["term"] for r in query_tokens(index.spark, query, tokenizer).collect()]
    if not words:
        return index.spark.createDataFrame([], f"id {dict(index.table('documents').dtypes)['id']}, raw double, span long")
    lists = _lists(index, words).select("term", "generation", F.explode("postings").alias("p"))
    live = _live(index, lists.select("term", "generation", "p.*"), book_ids)
    full = live.groupBy("id").agg(F.collect_set("term").alias("held"), F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list(
        F.transform("positions", lambda at: F.struct(at.alias("at"), F.array_position(F.array(*map(F.lit, words)), F.col("term")).alias("which")))
    ))).alias("places")).where(F.size("held") == len(words))
    # one walk over a chunk's places: the last place of each word so far, and the shortest stretch that ends here
    start = F.struct(F.array_repeat(F.lit(-1), len(words)).alias("last"), F.lit(None).cast("int").alias("span"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i + 1 == x["which"], x["at"]).otherwise(v))
        span = F.when(F.array_min(last) >= 0, x["at"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(s["span"], span).alias("span"))

    spans = full.select("id", "tf", F.aggregate("places", start, step, lambda s: s["span"]).cast("long").alias("span"))
    ranked = spans.select("id", (F.lit(float(len(words))) / F.col("span")).alias("raw"), "span", "tf")
    return ranked.orderBy(F.desc("raw"), F.desc("tf"), "id").limit(k).drop("tf")
