"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint is the majority, bit by bit, over the XXH64 hashes of its word shingles. Two fingerprints that
differ in at most `radius` bits have a point within radius / 2 of both. So every distinct fingerprint emits all variants
within half the radius, the variants are shuffled, and fingerprints that meet at a variant are linked. All that meet at
one variant are within `radius` of each other (two steps of half the radius), hence a link to the least of them, verified
once more by counting bits, stands for all their pairs; and a variant can't hold more fingerprints than its own ball has
points, 65 for radius 2, however many documents there are. Copies share a fingerprint and are one row in all of this.

Defined cases: null or empty text and text of spaces has fingerprint zero, which is linked like any other; fewer words
than a shingle has give the whole sequence as one; a very long text is hashed block by block; repeated rows are copies; ties
between ids don't arise, as the least one names a component; null ids belong to the component but can't name it, so one of
null ids alone has a null name; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, spread_join, table, written

BITS = 64
#: Shingles that are turned to bits at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """As a signed number. Lower case is that of A-Z; words are split at spaces and the characters 9 to 13."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, shingle = xxhash.xxh64_digest, min(shingle, len(words))
    n, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for start in range(0, n, BLOCK):
        some = words[start : start + BLOCK + shingle - 1]
        hashes = b"".join([digest(b" ".join(x), seed) for x in zip(*(some[i:] for i in range(shingle)))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """Zero and every mask of up to radius / 2 bits, as signed numbers."""
    if radius % 2:
        raise ValueError("the radius must be even: the ball around a variant then has it as its diameter")
    out = [sum(1 << i for i in bits) for r in range(radius // 2 + 1) for bits in itertools.combinations(range(BITS), r)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct pairs (a, b) of the distinct fingerprints in column fp that connect all within `radius` bits."""
    balls = prints.select("fp").distinct().withColumn("mask", F.explode(F.array(*map(F.lit, masks(radius)))))
    variants = balls.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the least id of all documents that links reach."""
    prints = written(fingerprints(docs, shingle))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")))
    roots = components(links(classes, radius))
    least = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select("node", "least")
    named = classes.join(linked, classes["fp"] == linked["node"], "left")
    named = named.select("fp", F.coalesce("least", "first").alias("component_id"))
    # a group of copies is one fingerprint
    return spread_join(prints, named, "fp", counts=classes).select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")
