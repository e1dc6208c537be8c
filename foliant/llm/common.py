"""Shared storage and column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


#: Rows that a file of a stashed table has at least, where it is known how many the table has at most.
FILE_ROWS = 1 << 14


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/foliant/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage, and what a lost executor computed is read again, not computed again.
    ``rows``, the most that it may have, keeps a small table from a file for each shuffle
    partition. On local file systems every file and folder is a ``chmod`` of the executor, and
    until that process has begun it counts the executor's memory once more.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what runs inside; they are as before afterwards."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; all else is left out."""
    return df.select(*(df[f"`{src}`"].alias(dst) for dst, src in columns.items()))


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """The schema with one more field; the schema itself stays as it is."""
    return StructType([*schema.fields, StructField(name, DataType.fromDDL(kind))])


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids give null."""
    return F.crc32(doc_id.cast("string")) % n
