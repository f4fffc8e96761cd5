"""What the operators share: ranks without a global window, null-safe joins, and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.storage import new_folder, written

__all__ = ["SPACES", "WORD", "components", "new_folder", "null_safe", "ranked", "spread_join", "table", "written"]

#: A word is a run of anything but a space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A key with more than a share of 1 / HOT_KEYS of all rows, and with more than LEAST_HOT, is dealt to several parts.
HOT_KEYS, LEAST_HOT = 1000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Ranks rows within groups of any size without a window over them.

    Rows are range-partitioned by (within, order), sorted and written with their position. A run is what one partition
    holds of one group. Returns the rows with `_part` and `_at`, the runs with `_before` (what the rank of a row is less
    than its `_at`), and the columns to join the two by; the rank is then `_at + _before`, from 1.
    Nulls come last. Rows that tie in all columns of `order` are ranked in any order.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*within, *order)]
    rows = written(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    runs = rows.groupBy("_part", *within).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1)
    return rows, runs.drop("_first", "_rows"), ["_part", *within]


def null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null; the right side's key columns are dropped."""
    names = {c: f"_right_{c}" for c in by}
    right = right.withColumnsRenamed(names)
    on: Column | None = None
    for c, other in names.items():
        this = left[c].eqNullSafe(right[other])
        on = this if on is None else on & this
    return left.join(right, on, how).drop(*names.values())


def spread_join(rows: DataFrame, others: DataFrame, key: str, by: Sequence[str] = (), counts: DataFrame | None = None, how: str = "inner", merge: bool = False) -> DataFrame:
    """rows joined with others, which has a row for each value of `key`, however many rows share one.

    The rows of a hot key are dealt to parts, by a hash of the columns `by` or, of a written table, by their numbers; the
    other side's row is there once for each part. There can't be more than HOT_KEYS hot keys, so their hashes come to the
    driver and stand in the plan; nothing is broadcast. A key that shares a hash with a hot one is dealt as well, on both sides.
    `counts` has _n for each key if it's known, and is read twice; else the rows are counted, so they should be cheap to read."""
    if counts is None:
        counts = written(rows.groupBy(key).agg(F.count("*").alias("_n")))
    hashed = F.xxhash64(F.col(key).cast(rows.schema[key].dataType))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(LEAST_HOT, (total or 0) // HOT_KEYS)
    hot: dict[int, list[int]] = {}  # by number of parts, a power of two
    for n, x in counts.where(F.col("_n") > limit).select("_n", hashed).collect() if (most or 0) > limit else ():
        hot.setdefault(1 << ((n - 1) // limit).bit_length(), []).append(x)
    parts = F.lit(1)
    for n, some in sorted(hot.items()):
        parts = F.when(hashed.isin(some), n).otherwise(parts)
    number = F.xxhash64(*by) if by else F.monotonically_increasing_id()
    # also without hot keys, so that plans are alike with and without
    left = rows.withColumn("_salt", F.pmod(number, parts).cast("int"))
    right = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return (left.hint("merge") if merge else left).join(right, [key, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs, any direction; returns (node, root), root the least node that a node reaches, as a written table.

    Alternates two star steps, both a grouped minimum and a join, until only stars are left; each round is written to
    the shared folder. Nothing but whether there is more to do and hot nodes (see spread_join) comes to the driver.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = written(both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("root"), F.count("*").alias("_n")))
        # where each node that has a lesser one has no other, that one has none: these are stars
        if least.where("root < hi and _n > 1").isEmpty():
            return least.select(F.col("hi").alias("node"), "root")
        # a node with links to a third of all others is in no task alone
        large = spread_join(both, least.drop("_n"), "hi", ["lo"], least).where("lo > hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        large = written(large)
        least = written(large.groupBy("hi").agg(F.min("lo").alias("root"), F.count("*").alias("_n")))
        small = spread_join(large, least.drop("_n"), "hi", ["lo"], least)
        edges = written(
            small.where("lo <> root")
            .select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
            .unionByName(least.select("hi", F.col("root").alias("lo")))
            .distinct()
        )
