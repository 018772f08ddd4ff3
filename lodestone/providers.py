"""Models and services as interfaces, and deterministic stand-ins for use offline.

A stand-in is no model: it only keeps pipelines runnable and tests repeatable. Pass a real
provider to get real embeddings, scores and answers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ServiceError(Exception):
    """A service that a step needs did not answer."""


class ModelUnavailable(ServiceError):
    pass


class StoreUnavailable(ServiceError):
    pass


class RetrievalFailed(ServiceError):
    pass


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Chat(Protocol):
    def answer(self, messages: list[dict]) -> str: ...

    def stream(self, messages: list[dict]) -> Iterator[str]: ...


class PageReader(Protocol):
    """PDF or image pages as rows (page_no, text, blocks, tables)."""

    def pages(self, content: bytes) -> list[dict]: ...


class HashEmbedder:
    """Stand-in: signed hashes of words, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts):
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


class OverlapReranker:
    """Stand-in: share of the query's distinct words that the passage holds."""

    def __init__(self, max_length: int = 512):
        self.max_length = max_length

    def score(self, pairs):
        split = lambda t: set(re.findall(r"[a-z0-9]+", (t or "").lower()))
        return [len(split(q) & split(p[: 4 * self.max_length])) / max(1, len(split(q))) for q, p in pairs]


class EchoChat:
    """Stand-in: repeats the last message's first line."""

    def answer(self, messages):
        return (messages[-1]["content"] if messages else "").split("\n")[0]

    def stream(self, messages):
        yield from re.findall(r"\S+\s*", self.answer(messages))


def embed_column(texts: DataFrame, provider, column: str = "text") -> DataFrame:
    """texts with ``embedding``; one call a batch of rows, the provider made once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for batch in batches:
            yield pd.Series(model.embed(batch.tolist()))

    return texts.withColumn("embedding", run(column))


def rerank(hits: DataFrame, provider, keep: int) -> DataFrame:
    """hits (query_id, pos, query, content, ...) with the model's scores, the best ``keep`` of each query."""
    from pyspark.sql import Window

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = provider()
        for queries, contents in batches:
            yield pd.Series(model.score(list(zip(queries, contents))), dtype="float64")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    scored = hits.withColumn("score", run("query", "content")).withColumn("__n", F.row_number().over(order))
    return scored.where(F.col("__n") <= keep).withColumn("pos", F.col("__n")).drop("__n")


def chat_column(messages, provider):
    """Answers to user messages (array of strings, in order); null messages are not asked. One model a worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for batch in batches:
            yield pd.Series([None if m is None else model.answer([{"role": "user", "content": x} for x in m]) for m in batch], dtype="object")

    return run(messages)
