"""A bounded sample of labelled documents, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import crc_remainder, pick, stash


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: tuple[int, int] | None = None, most_bytes: int | None = None
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, those of least hash, with their whole texts.

    ``held_out`` = (n, r) leaves out rows whose crc32(doc_id as text) mod n is r. With
    ``most_bytes`` documents are taken in that order while their texts are within that size
    together, one at least. Rows without a label, an id or a text are left out; of rows that
    repeat a doc_id one is taken.
    """
    ids = pick(labels, doc_id="doc_id", label=label).where("doc_id is not null and label is not null")
    if held_out:
        ids = ids.where(crc_remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    ids = ids.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    texts = pick(docs, doc_id="doc_id", text="text").where("text is not null")
    # at most ``rows`` ids are broadcast; texts of one id are reduced to one before they move
    found = texts.join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    if most_bytes is None:
        return found
    found = stash(found, "sample")
    so_far = Window.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = found.select("doc_id", (F.octet_length("text") + F.coalesce(F.sum(F.octet_length("text")).over(so_far), F.lit(0))).alias("end"), F.row_number().over(
        Window.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")).alias("place"))
    return found.join(F.broadcast(sized.where((F.col("end") <= most_bytes) | (F.col("place") == 1)).select("doc_id")), "doc_id", "left_semi")
