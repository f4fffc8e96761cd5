"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, rotated by one random orthogonal matrix and kept as the signs of their components, packed to bits,
with two numbers each: the norm, and how well the signs stand for the vector. From the bits alone the inner product with
a rotated query is estimated, and from the two numbers how far it can be off; the bound on the distance that follows tells
which vectors can still be among the nearest, and those alone are measured exactly, on the original vectors, in double
precision.

Vectors that are equal are one class, with the smallest ids that a list of nearest can need. The index is a table of blocks
of classes, coded once and written: ids, packed codes, and the two numbers of each. Short vectors are padded to `BITS`
dimensions before they are turned, as longer codes have narrower bounds. Queries come in blocks as well and meet blocks of
codes only, each pair as matrix products. A first pass finds for each query the classes that look nearest; those are
measured on their vectors, and the last of the nearest is a limit. A second pass gives the classes whose lower bound is
within the limit, and a join with the table of vectors measures those. Neither all queries nor all vectors are ever in one
place, and vectors are only in the joins of what is measured. Vectors of different lengths aren't compared.

Defined cases: vectors that are null, zero, empty or hold a null or a non-finite component take no part, neither as query
nor as candidate; rows that repeat an id and its vector count once; rows that share an id but not the vector are queries
of their own; a query's own id is no candidate; ties go to the smaller id; rows without an id take no part; fewer
candidates than wanted are all returned; very long vectors are coded in blocks of fewer; an empty table gives an empty
result. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, table, written

#: Classes and queries in a block, and numbers in a block's vectors at most.
BLOCK, QUERIES, NUMBERS = 16384, 1024, 1 << 22
#: Classes of a block that a task compares at once.
SLICE = 2048
#: Bits of a code; as many as dimensions if those are more.
BITS = 512
#: Deviations of the estimate that the bound allows for.
DEVIATIONS = 2.5
TOP = 10
#: Times as many as wanted are measured to find the limit for the others.
LIKELY = 4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dim of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"), bad.alias("_bad"))
    fine = F.col("vec_id").isNotNull() & (F.col("dim") > 0) & ~F.col("_bad") & F.exists("embedding", lambda x: x != 0)
    return rows.where(fine).drop("_bad").dropDuplicates(["vec_id", "embedding"])


def width(dim: int) -> int:
    return max(BITS, -(-dim // 8) * 8)


@lru_cache(4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """Takes vectors to width(dim) dimensions: padded with zeros, then turned at random."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((width(dim), dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and the inner products of unit vectors with their codes."""
    y = (x - centre) @ turn
    norm = np.linalg.norm(y, axis=1)
    fit = np.abs(y).sum(axis=1) / (np.sqrt(turn.shape[1]) * np.where(norm > 0, norm, 1))
    return np.packbits(y > 0, axis=1), norm, np.where(norm > 0, fit, 1.0)


def bounds(codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, queries: np.ndarray, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and lower bounds of the squared distances from turned, centred queries to the coded vectors; a row for
    each query."""
    bits = queries.shape[1]
    length = np.linalg.norm(queries, axis=1)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    inner = queries.astype(np.float32) @ signs.T / (np.sqrt(bits) * fit).astype(np.float32)
    off = deviations * np.sqrt(np.maximum(1 - fit**2, 0)) / (fit * np.sqrt(max(bits - 1, 1)))
    both = norm[None, :] ** 2 + length[:, None] ** 2
    middle = both - 2 * norm[None, :] * inner
    # the last part is single precision's
    return middle, middle - 2 * length[:, None] * (norm * off)[None, :] - 1e-5 * both


def classes(rows: DataFrame, top: int) -> DataFrame:
    """cid, embedding, dim and ids, the top + 1 smallest, of each distinct vector."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    some = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top + 1)
    some = some.groupBy("embedding").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return written(some.withColumn("cid", F.monotonically_increasing_id()))


def dealt(rows: DataFrame, size: int, name: str, columns: list[str]) -> DataFrame:
    """dim, a number in column `name`, and the rows with it as an array, about `size` of them."""
    longest, n = rows.agg(F.max("dim"), F.count("*")).first()
    blocks = max(1, -(-n // max(1, min(size, NUMBERS // max(longest or 1, 1)))))
    named = rows.withColumn(name, F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int"))
    return named.groupBy("dim", name).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _vectors(rows: pa.Array) -> np.ndarray:
    return rows.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def index(known: DataFrame) -> DataFrame:
    """dim, block, cids, codes, norms, fits and centre: each block of classes, coded once and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, rows in enumerate(b.column(2)):
                x = _vectors(rows.values)
                centre = x.mean(axis=0)
                codes, norm, fit = encode(x, centre, rotation(x.shape[1]))
                lists = [pa.array([y], pa.list_(pa.float64())) for y in (norm, fit, centre)]
                cids = pa.ListArray.from_arrays([0, len(x)], rows.values.field("cid"))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), cids, pa.array([codes.tobytes()], pa.binary()), *lists], NAMES)

    return written(dealt(known, BLOCK, "block", ["cid", "embedding"]).mapInArrow(run, "dim int, block int, cids array<long>, codes binary, norms array<double>, fits array<double>, centre array<double>"))


NAMES = ["dim", "block", "cids", "codes", "norms", "fits", "centre"]


def compared(coded: DataFrame, asked: DataFrame, likely: int = 0) -> DataFrame:
    """qid, cid and guess: of each block of codes the `likely` classes that look nearest to each query, or all whose lower
    bound is within the query's limit. asked(cid, embedding, dim, limit)."""
    parts = dealt(asked, QUERIES, "part", ["cid", "embedding", "limit"])
    numbers = parts.select("dim", "part").distinct()
    blocks = coded.select("dim", "block").distinct()
    left = coded.join(numbers, "dim")
    right = parts.withColumnRenamed("rows", "queries").join(blocks, "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cids, norm, fit, centre = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
                codes = np.frombuffer(b.column(1)[i].as_py(), np.uint8).reshape(len(cids), -1)
                queries = b.column(5)[i].values
                ids, limit = (queries.field(k).to_numpy(zero_copy_only=False) for k in ("cid", "limit"))
                turned = (_vectors(queries) - centre) @ rotation(len(centre))
                for at in range(0, len(cids), SLICE):
                    part = slice(at, at + SLICE)
                    middle, low = bounds(codes[part], norm[part], fit[part], turned)
                    if likely and middle.shape[1] > likely:
                        near = np.argpartition(middle, likely, axis=1)[:, :likely]
                        q, c = np.repeat(np.arange(len(ids)), likely), near.ravel()
                    else:
                        q, c = np.nonzero(low <= limit[:, None] ** 2 if not likely else np.ones_like(low, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(cids[part][c], pa.int64()), pa.array(middle[q, c].astype(np.float64))], ["qid", "cid", "guess"])

    pairs = left.join(right, ["dim", "block", "part"]).select(*NAMES[2:], "queries")
    return pairs.mapInArrow(run, "qid long, cid long, guess double")


def measured(pairs: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, cid, score (the distance, on the vectors themselves) and ids."""
    rows = pairs.select("qid", "cid").join(known.select("cid", "ids", "embedding"), "cid")
    rows = rows.join(asked.select(F.col("cid").alias("qid"), F.col("embedding").alias("_query")), "qid")
    off = F.zip_with("embedding", "_query", lambda a, b: a.cast("double") - b.cast("double"))
    return rows.select("qid", "cid", F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)).alias("score"), "ids")


def search(vectors: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score: for each vector whose id is divisible by `every`, the nearest others."""
    rows = written(usable(vectors))
    known = classes(rows, top)
    named = written(spread_join(written(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")), known.select("embedding", "cid"), "embedding").select("query_id", "cid"))
    asked = written(known.join(named.select("cid").distinct(), "cid").select("cid", "embedding", "dim", F.lit(float("inf")).alias("limit")))
    coded = index(known)
    # a query's own class is among its nearest, so one more is looked for
    best = lambda score, *then: Window.partitionBy("qid").orderBy(score, *then)
    first = compared(coded, asked, LIKELY * (top + 1)).withColumn("_n", F.row_number().over(best("guess", "cid"))).where(F.col("_n") <= LIKELY * (top + 1))
    limits = measured(first, known, asked).withColumn("_n", F.row_number().over(best("score", "cid"))).where(F.col("_n") == top + 1)
    limited = asked.drop("limit").join(limits.select(F.col("qid").alias("cid"), F.col("score").alias("limit")), "cid", "left")
    limited = written(limited.withColumn("limit", F.coalesce("limit", F.lit(float("inf")))))
    found = measured(compared(coded, limited), known, asked)
    found = found.withColumn("_n", F.row_number().over(best("score", F.col("ids")[0]))).where(F.col("_n") <= top + 1)
    lists = F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct("score", i.alias("vec_id"))))))
    found = found.groupBy(F.col("qid").alias("cid")).agg(lists.alias("_found"))
    rows = spread_join(named, found, "cid")
    nearest = F.slice(F.filter("_found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    rows = rows.select("query_id", F.posexplode(nearest).alias("_at", "_one"))
    return rows.select("query_id", (F.col("_at") + 1).alias("rank"), "_one.vec_id", "_one.score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
