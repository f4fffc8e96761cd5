"""Shards by a Feistel permutation of global row numbers.

Every row has a number from 0 to n - 1. A Feistel network permutes the numbers below the next power of 4; a result that isn't
below n is permuted again until it is (cycle walking), which makes a permutation of the n numbers. A row's place in the
shuffled order is its permuted number; its shard is that modulo the number of shards, and its slot what remains. So counts
of shards are at most one apart, slots have no gaps, and either way round is computed: `Shuffle.place` tells where a row
goes, `Shuffle.row_at` which row is at a place, without a look at any other row.

A table's rows are numbered by file name and the row's index in its file (`numbered_table`), which moves nothing and doesn't
depend on splits; rows of any other DataFrame by an order of theirs (`numbered`). Texts are moved once, to their shard.

Defined cases: nulls in any column and very long texts are carried whole, a null text has no bytes; repeated rows have
numbers, and so places, of their own; rows that tie in the order given to `numbered` are numbered in any order; further
columns are carried along under any names; an empty table gives no shard and an empty result. No group of rows is kept
together, so equal texts are shuffled like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, ranked

ROUNDS = 6
#: Rows in a file of a shard, at most.
FILE_ROWS = 1 << 15
#: Files whose first numbers are broadcast; a plain join beyond.
MOST_FILES = 100_000


@dataclass(frozen=True)
class Shuffle:
    """A permutation of the numbers below n, fixed by the seed."""

    n: int
    shards: int
    seed: str = "shards"

    @property
    def half(self) -> int:
        """Bits of each half of a number."""
        return (max(self.n - 1, 1).bit_length() + 1) // 2

    def keys(self) -> list[np.uint64]:
        return [np.uint64(int.from_bytes(hashlib.sha256(f"{self.seed}:{i}".encode()).digest()[:8], "big")) for i in range(ROUNDS)]

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        """The round function: any `half` bits of a number and a key. Products wrap around."""
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x >> np.uint64(64 - self.half)

    def _network(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        if inverse:
            for key in reversed(self.keys()):
                left, right = right ^ self._mixed(left, key), left
        else:
            for key in self.keys():
                left, right = right, left ^ self._mixed(right, key)
        return (left << half) | right

    def _walked(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        out = self._network(np.asarray(x).astype(np.uint64), inverse)
        while (beyond := out >= np.uint64(self.n)).any():
            out[beyond] = self._network(out[beyond], inverse)
        return out.astype(np.int64)

    def position(self, rows: np.ndarray) -> np.ndarray:
        """Where rows are in the shuffled order, by their numbers."""
        return self._walked(rows, False)

    def place(self, row: int) -> tuple[int, int]:
        """The shard and slot of a row."""
        at = int(self.position(np.array([row]))[0])
        return at % self.shards, at // self.shards

    def row_at(self, shard: int, slot: int) -> int:
        """The number of the row at a place."""
        return int(self._walked(np.array([slot * self.shards + shard]), True)[0])


def numbered_table(spark: SparkSession, path: str) -> DataFrame:
    """row (all columns) and number of a Parquet table's rows: files in the order of their names, rows as they lie."""
    rows = spark.read.parquet(path)
    rows = rows.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = rows.groupBy("_file").agg((F.max("_index") + 1).alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    few = len(rows.inputFiles()) <= MOST_FILES
    return rows.join(F.broadcast(files) if few else files, "_file").select("row", (F.col("_first") + F.col("_index")).alias("number"))


def numbered(docs: DataFrame, order: Sequence[str]) -> DataFrame:
    """row (all columns) and number of any rows, in an order of theirs, nulls last."""
    keyed = docs.select(F.struct("*").alias("row"), *(F.col(c).alias(f"_key{i}") for i, c in enumerate(order)))
    rows, runs, by = ranked(keyed, [], [f"_key{i}" for i in range(len(order))], "number")
    return rows.join(F.broadcast(runs), by).select("row", (F.col("_at") + F.col("_before") - 1).alias("number"))  # a run for each partition


def placed(rows: DataFrame, shuffle: Shuffle) -> DataFrame:
    """Adds shard and slot to rows that have a number."""

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(shuffle.position(number.to_numpy()))

    at = rows.withColumn("_position", position("number"))
    return at.withColumns({"shard": F.pmod("_position", F.lit(shuffle.shards)).cast("int"), "slot": F.floor(F.col("_position") / shuffle.shards)}).drop("_position")


def write_shards(rows: DataFrame, shuffle: Shuffle, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes each shard to its folder `shard=...`, in files of consecutive slots, sorted; returns what is read back: row,
    number, slot and shard."""
    files = max(1, -(-shuffle.n // (shuffle.shards * file_rows)))
    at = placed(rows, shuffle)
    file = F.col("shard") * files + F.least(F.floor(F.col("slot") / file_rows), F.lit(files - 1))
    dealt = at.repartitionById(shuffle.shards * files, file.cast("int")).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(folder)
    kind = at.select("row", "number", "slot", "shard").schema
    return rows.sparkSession.read.schema(kind).parquet(folder)


def sharded_table(spark: SparkSession, path: str, shards: int, seed: str = "shards", folder: str | None = None) -> DataFrame:
    """A Parquet table's rows in shards: row, number, slot and shard, from the files of the shards."""
    rows = numbered_table(spark, path)
    shuffle = Shuffle(spark.read.parquet(path).count(), shards, seed)
    return write_shards(rows, shuffle, folder or new_folder(spark))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("row.text", F.lit(""))
    return sharded_table(spark, f"{sf_dir}/documents.parquet", 8).select(
        "row.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
