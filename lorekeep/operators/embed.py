"""Embedding with a cache: only texts that are new are embedded, each once."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.keys import cache_key, truncate_utf8

PREFIXES = ("search_document: ", "search_query: ", "clustering: ", "classification: ")


def task_type(prefix: str) -> str:
    """What a service calls the task that a prefix stands for."""
    return "query" if prefix.startswith("search_query") else "document"


class PermanentError(Exception):
    """An error that trying again doesn't mend."""


class Embedder(Protocol):
    """Vectors of texts that have their prefix already; raised errors are transient unless PermanentError."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]: ...


class MockEmbedder:
    """A unit vector that the text alone decides; for tests, it can fail on texts that hold a word."""

    def __init__(self, dims: int, fails_on: str = "", permanent: bool = False):
        self.dims, self.fails_on, self.permanent = dims, fails_on, permanent

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.fails_on and self.fails_on in t:
                raise PermanentError("refused") if self.permanent else ConnectionError("out of order")
            data = t.encode()
            v = np.random.default_rng([zlib.crc32(data), len(data)]).standard_normal(self.dims)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return out


def attempt(embedder: Embedder, texts: list[str], dims: int, tries: int = 3, pause: float = 0.0) -> list[tuple[np.ndarray | None, str | None, bool]]:
    """(vector, error, permanent) of each text. All go together first; if that fails, each goes alone, so that one bad text
    fails no other. Transient errors and wrong lengths are tried again, each time after `pause` seconds more."""

    def one(part: list[str]) -> list[tuple[np.ndarray | None, str | None, bool]]:
        error, permanent = "", False
        for again in range(tries):
            time.sleep(pause * again)
            try:
                found = [np.asarray(v, np.float32) for v in embedder(part)]
            except PermanentError as e:
                error, permanent = str(e), True
                break
            except Exception as e:  # noqa: BLE001  whatever a service raises
                error = str(e)
                continue
            wrong = [len(v) for v in found if len(v) != dims]
            if len(found) == len(part) and not wrong:
                return [(v, None, False) for v in found]
            error, permanent = f"{wrong[0] if wrong else len(found)} numbers instead of {dims if wrong else len(part)}", bool(wrong)
        return [(None, error, permanent)] if len(part) == 1 else [x for t in part for x in one([t])]

    return one(texts) if texts else []


def embed(texts: DataFrame, cache: DataFrame, prefix: str, model: str, embedder: Callable[[], Embedder], dims: int, batch: int = 32, most_bytes: int = 1200, pause: float = 0.0) -> DataFrame:
    """texts(id, text) to id, content_hash, embedding, error_message, permanent, cached.

    The key is of the whole text with its prefix; equal texts are embedded once and joined back. The service gets a text's
    first `most_bytes` bytes, cut between characters (0: all), as such services read no more. A text that has a prefix
    already is a permanent error."""
    doubled = F.lit(False)
    for p in PREFIXES:
        doubled = doubled | F.startswith(F.col("text"), F.lit(p))
    rows = texts.select("id", "text", doubled.alias("_doubled"), cache_key(F.lit(prefix), F.col("text")).alias("content_hash"))
    known = cache.where((F.col("model") == model) & (F.col("task_prefix") == prefix)).select("content_hash", F.col("vector").alias("_vector"))
    missing = rows.where("not _doubled").join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.first("text").alias("text"))
    if most_bytes > 0:
        missing = missing.withColumn("text", truncate_utf8(F.col("text"), most_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = embedder()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                got = attempt(service, [prefix + t for t in part["text"]], dims, pause=pause)
                yield pd.DataFrame(
                    {
                        "content_hash": part["content_hash"].tolist(),
                        "_vector": [None if v is None else v.astype("<f4").tobytes() for v, _, _ in got],
                        "_error": [e for _, e, _ in got],
                        "_permanent": [p for _, _, p in got],
                    }
                )

    made = missing.mapInPandas(run, "content_hash binary, _vector binary, _error string, _permanent boolean")
    every = made.withColumn("cached", F.lit(False)).unionByName(known.withColumn("cached", F.lit(True)), allowMissingColumns=True)
    out = rows.join(every, "content_hash", "left")
    return out.select(
        "id",
        "content_hash",
        F.when(~F.col("_doubled"), F.col("_vector")).alias("embedding"),
        F.when(F.col("_doubled"), F.lit("the text has a prefix already")).otherwise(F.col("_error")).alias("error_message"),
        (F.col("_doubled") | F.coalesce("_permanent", F.lit(False))).alias("permanent"),
        (~F.col("_doubled") & F.coalesce("cached", F.lit(False))).alias("cached"),
    )


def cache_misses(texts: DataFrame, cache: DataFrame, prefix: str, model: str) -> DataFrame:
    """texts(text) whose key isn't in the cache, each once."""
    rows = texts.select("text", cache_key(F.lit(prefix), F.col("text")).alias("content_hash"))
    known = cache.where((F.col("model") == model) & (F.col("task_prefix") == prefix)).select("content_hash")
    return rows.join(known, "content_hash", "left_anti").dropDuplicates(["content_hash"])


def cacheable(embedded: DataFrame, cache: DataFrame, prefix: str, model: str, dims: int, at: Column) -> DataFrame:
    """Rows to append to the cache: new vectors, each key once."""
    new = embedded.where("embedding is not null and not cached").dropDuplicates(["content_hash"])
    known = cache.where((F.col("model") == model) & (F.col("task_prefix") == prefix)).select("content_hash")
    return new.join(known, "content_hash", "left_anti").select(
        "content_hash", F.lit(model).alias("model"), F.lit(prefix).alias("task_prefix"), F.lit(dims).cast("smallint").alias("dims"), F.col("embedding").alias("vector"), at.alias("created_at")
    )


def rows_by_prefix(cache: DataFrame) -> DataFrame:
    return cache.groupBy("task_prefix").agg(F.count("*").alias("n")).orderBy("task_prefix")
