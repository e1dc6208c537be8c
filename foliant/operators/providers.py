"""Models that the pipelines call: embedders, language models, named tools, and their test doubles."""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import hash_embedding

BATCH = 32


class ServiceCallError(RuntimeError):
    """A provider call that failed, with a message that says why."""

    @classmethod
    def of_status(cls, service: str, status: int | None) -> ServiceCallError:
        if status is None:
            return cls(f"{service} is out of reach")
        if status in (401, 403):
            return cls(f"{service} refused the key (HTTP {status})")
        if status == 404:
            return cls(f"{service} does not know the model or address (HTTP 404)")
        return cls(f"{service} answered HTTP {status}")


class Embedder(ABC):
    @abstractmethod
    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """A vector for each text, in order."""


class HashEmbedder(Embedder):
    """The offline default: bytes of the text's SHA-256."""

    def __init__(self, dimensions: int = 8):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        digests = (hashlib.sha256(t.encode("utf-8")).digest() for t in texts)
        return [[(d[i % 32] - 128) / 128 for i in range(self.dimensions)] for d in digests]


class LanguageModel(ABC):
    @abstractmethod
    def stream(self, messages: Sequence[dict]) -> Iterator[str]:
        """Pieces of the answer."""

    def complete(self, prompt: str) -> str:
        return "".join(self.stream([{"role": "user", "content": prompt}])).strip()

    def decide(self, messages: Sequence[dict], tools: Sequence[dict]) -> dict:
        """{"tool_calls": [{"name", "arguments"}]}; none by default."""
        return {"tool_calls": []}


class ExtractiveModel(LanguageModel):
    """A deterministic stand-in: the first ``most`` characters of the last message, one at a time."""

    def __init__(self, most: int = 80):
        self.most = most

    def stream(self, messages: Sequence[dict]) -> Iterator[str]:
        yield from (messages[-1]["content"] if messages else "")[: self.most]


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, batch: int = BATCH) -> DataFrame:
    """``chunks`` plus ``vector``. The default embedder is a column expression; others run in Arrow batches."""
    if embedder is None:
        return chunks.withColumn("vector", hash_embedding(F.col("content")))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got: list[list[float]] = []
            for at in range(0, len(texts), batch):
                got += embedder.embed(texts.iloc[at : at + batch].fillna("").tolist())
            yield pd.Series(got, index=texts.index)

    return chunks.withColumn("vector", run("content"))


def complete_column(prompts: DataFrame, column: str, model: LanguageModel, into: str) -> DataFrame:
    """The model's answer to each prompt; an empty prompt is not sent."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: model.complete(t) if t else "")

    return prompts.withColumn(into, run(column))


#: Parts in which stored calls are made: what a run that dies loses is one part.
PARTS = 16


def complete_stored(prompts: DataFrame, column: str, model: LanguageModel, into: str, path: str, parts: int = PARTS) -> DataFrame:
    """``complete_column`` with a table of calls (digest, answer) under ``path``: no prompt that it has is asked again.

    Distinct prompts are written first, then asked in ``parts``, each appended when it is done. A
    lost executor repeats its task alone; a run that died goes on with the parts that lack. A plan
    may hold each ``path`` once: Spark takes two reads of one path for the same rows.
    """
    spark = prompts.sparkSession
    key = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    asked = prompts.where(F.coalesce(F.col(column), F.lit("")) != "").select(key.alias("digest"), F.col(column).alias("prompt"))
    asked.dropDuplicates(["digest"]).write.mode("overwrite").parquet(f"{path}/asked")
    asked = spark.read.parquet(f"{path}/asked")
    spark.createDataFrame([], "digest string, answer string").write.mode("append").parquet(f"{path}/answers")
    answers = lambda: spark.read.schema("digest string, answer string").parquet(f"{path}/answers")
    for part in range(parts):
        todo = asked.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part).join(answers().select("digest"), "digest", "left_anti")
        complete_column(todo, "prompt", model, "answer").select("digest", "answer").write.mode("append").parquet(f"{path}/answers")
    found = answers().dropDuplicates(["digest"])
    out = prompts.withColumn("call digest", key).join(found.withColumnRenamed("digest", "call digest"), "call digest", "left")
    return out.select(*prompts.columns, F.coalesce("answer", F.lit("")).alias(into))


def tool_arguments(call: dict) -> dict:
    """Arguments of a tool call, which may be JSON text; what can't be read counts as none."""
    arguments = call.get("arguments")
    if isinstance(arguments, dict):
        return arguments
    try:
        parsed = json.loads(arguments or "{}")
    except (TypeError, ValueError):
        return {}
    return parsed if isinstance(parsed, dict) else {}


class Tools:
    """Named queries that a model may ask for; a tool that fails answers with its error."""

    def __init__(self, tools: dict[str, Callable[..., dict]]):
        self.tools = tools

    def run(self, name: str, arguments: dict) -> dict:
        if name not in self.tools:
            return {"error": f"unknown tool: {name}"}
        try:
            return self.tools[name](**arguments)
        except Exception as e:  # the answer goes on without the tool
            return {"error": str(e)}


def sse_deltas(lines: DataFrame) -> DataFrame:
    """Contents of a server-sent event stream (stream_id, n, line), up to its [DONE]."""
    data = lines.where(F.col("line").startswith("data: ")).withColumn("data", F.substring("line", 7, 1 << 30))
    end = data.where("data = '[DONE]'").groupBy("stream_id").agg(F.min("n").alias("end"))
    got = data.join(end, "stream_id", "left").where(F.col("end").isNull() | (F.col("n") < F.col("end")))
    return _contents(got, F.get_json_object("data", "$.choices[0].delta.content"))


def ndjson_deltas(lines: DataFrame) -> DataFrame:
    """Contents of a stream of JSON lines (stream_id, n, line), up to the one that is done."""
    end = lines.where(F.get_json_object("line", "$.done") == "true").groupBy("stream_id").agg(F.min("n").alias("end"))
    got = lines.join(end, "stream_id", "left").where(F.col("end").isNull() | (F.col("n") <= F.col("end")))
    return _contents(got, F.get_json_object("line", "$.message.content"))


def _contents(rows: DataFrame, content) -> DataFrame:
    return rows.withColumn("content", content).where(F.coalesce("content", F.lit("")) != "").select("stream_id", "n", "content")
