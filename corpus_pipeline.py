"""A corpus pipeline of five training-data stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of documents; the last returns packed pieces. Between stages the rows are
written as Parquet in the shared folder and read again.

In every stage a null or empty text is a text without words, a text of any length is read
whole, rows that repeat a doc_id are rows of their own, a null doc_id sorts after all others,
an empty table gives an empty result, and columns beyond doc_id, text, lang and source are
passed on whatever their names (the last stage leaves them out).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, exactdedup, packing, quality, simhash, toxicity
from foliant.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A score of just the threshold is accepted. Null sources and languages are sites of their
    own. Rows that are equal have equal scores and stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, keep_row=True).where("kept").select("record.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    A score of just the threshold is rejected. Texts without words stay. Equal texts stay or
    go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # a name that no column of the caller has
    text = f"c{docs.columns.index('text')}"
    scored = toxicity.score(numbered, toxicity.train(docs, labels), text).where(F.col("score") < toxicity.THRESHOLD)
    return scored.drop("score").toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest doc_id, of rows that repeat it any one."""
    return exactdedup.exact_duplicates(docs, keep_row=True).where("kept").select("record.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints over four words that are within four bits, as op8_simhash links them.

    For texts that are all but equal; the stage of the pipeline is ``drop_similar``.
    """
    return simhash.near_duplicates(docs, keep_row=True).where("kept").select("record.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose shingles of five words have a similarity of 0.8 or more.

    Fingerprints of 512 bits find the candidates, and each link is confirmed on the whole
    texts. The document with the smallest doc_id of a component stays, of rows that repeat it
    any one. All texts without words are one component.
    """
    return simhash.near_duplicates(docs, shingle=5, similarity=0.8, keep_row=True).where("kept").select("record.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in full windows that hold the sources in proportion.

    A document without text has its end token. A null source is a source of its own.
    """
    return packing.piece_digest(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_similar),
    ("packing", pack),
]

#: The stages are trained models, a fingerprint forest and a tokenizer, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages leave of ``documents``: doc_id and the other columns of ``op2_packing``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
