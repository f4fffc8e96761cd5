"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with a least period q that is at least max(12, 2 * q) words long and that no
neighbouring word extends. For each power of two L, every factor of L words has a name that equal factors share (two halves'
names make the next level's). A run whose period is from L to 2L - 1 has a factor that occurs again one period later, so
the occurrences of each factor that follow within 2L are looked at. Those that are L / 2 or less apart form an arithmetic
progression whose step is the factor's own period, and only a progression's first and last member can propose another
period: a run that starts inside one progression ends it in both copies or starts the other. So each position proposes a few periods. Each proposal is extended to both sides by the
names, from the longest factors to the shortest; of the same stretch the least period is kept.

Factors that occur once are left out of the next level, so most levels of plain prose are almost empty. All documents of a
batch are worked on at once, as one array of word numbers with a mark between documents; a document is always worked on
whole, in 4 bytes for each word and level.

Defined cases: a null or blank text has no words and no runs, and collapses to an empty text; a very long text is
worked on alone; rows that are repeated, tie or share an id are each looked at; nulls and clashing names in further columns
are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of a run, at least.
LEAST = 12
#: Words that are worked on at once, but for a longer document.
CHUNK = 1 << 18

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(documents: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words as numbers, equal for equal words of one document alone, with a number of its own after each
    document; and where each document starts."""
    out, starts, used = [], [], 0
    at = 0
    for words in documents:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + used)
        out.append(np.array([used + len(known)], np.int64))
        used += len(known) + 1
        starts.append(at)
        at += len(words) + 1
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(starts, np.int64)


def proposals(positions: np.ndarray, names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) for periods from `length` to twice that, exclusive, from the occurrences of factors of that
    length: `names` at rising `positions`. Of positions in a row with the same period the first is kept."""
    order = np.argsort(names, kind="stable")
    at, name = positions[order], names[order]
    last = np.append(name[1:] != name[:-1], True)  # of its factor's occurrences
    gap = np.append(np.diff(at), 0)
    ends = np.flatnonzero(last | (2 * gap > length))  # of progressions
    end_of = ends[np.searchsorted(ends, np.arange(len(at)))]
    found_at, found = [], []
    asking, end = np.arange(len(at)), end_of
    while len(asking):
        more = ~last[end]
        asking, first = asking[more], end[more] + 1
        near = at[first] - at[asking] < 2 * length
        asking, first = asking[near], first[near]
        end = end_of[first]
        for member in (first, end):
            apart = at[member] - at[asking]
            fit = (apart >= length) & (apart < 2 * length)
            found_at.append(at[asking[fit]])
            found.append(apart[fit])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, period = np.concatenate(found_at), np.concatenate(found)
    order = np.lexsort((where, period))
    where, period = where[order], period[order]
    new = np.append(True, (period[1:] != period[:-1]) | (where[1:] > where[:-1] + 1)) if len(where) else np.zeros(0, bool)
    return where[new], period[new]


def levels_of(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The names of all factors, by powers of two (-1: it occurs once), and all proposals."""
    counts = np.bincount(words) if len(words) else np.zeros(0, np.int64)
    names = np.where(counts[words] > 1, words, -1).astype(np.int32)
    levels, where, period, length = [], [], [], 1
    while len(active := np.flatnonzero(names >= 0)):
        levels.append(names)
        a, b = proposals(active, names[active], length)
        where.append(a)
        period.append(b)
        halves = active[active + length < len(words)]
        halves = halves[names[halves + length] >= 0]
        pairs = names[halves].astype(np.int64) * (int(names.max()) + 1) + names[halves + length]
        _, pair, times = np.unique(pairs, return_inverse=True, return_counts=True)
        again = times[pair] > 1
        names = np.full(len(words), -1, np.int32)
        names[halves[again]] = pair[again]
        length *= 2
    none = np.zeros(0, np.int64)
    return levels, np.concatenate(where or [none]), np.concatenate(period or [none])


def stretches(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, length and period of all runs, by start and period."""
    levels, where, period = levels_of(words)
    start, end, n = where.copy(), where.copy(), len(words)  # `end` is where equality with the word a period later ends
    for k in reversed(range(len(levels))):
        names, step = levels[k], 1 << k
        i, j = end, end + period
        ok = j + step <= n
        ok[ok] = (names[i[ok]] >= 0) & (names[i[ok]] == names[j[ok]])
        end = end + np.where(ok, step, 0)
        i, j = start - step, start - step + period
        ok = i >= 0
        ok[ok] = (names[i[ok]] >= 0) & (names[i[ok]] == names[j[ok]])
        start = start - np.where(ok, step, 0)
    length = end + period - start
    found = np.column_stack([start, length, period])[(length >= 2 * period) & (length >= least)]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repetitions(documents: Sequence[Sequence[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each document its runs, and which words are kept: those that no run has after its first period."""
    words, starts = word_numbers(documents)
    found = stretches(words, least)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(cover)[:-1] == 0
    bounds = np.searchsorted(found[:, 0], np.append(starts, len(words)))
    out = []
    for i, at in enumerate(starts):
        own = found[bounds[i] : bounds[i + 1]].copy()
        own[:, 0] -= at
        out.append((own, kept[at : at + len(documents[i])]))
    return out


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[list[list[bytes]]]:
    """The texts' words, in chunks of about so many words; words are split at spaces and the characters 9 to 13."""
    held, n = [], 0
    for x in texts:
        words = (x.as_py() or "").encode().split()
        if held and n + len(words) > most:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def periodic(docs: DataFrame, carried: Sequence[str] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """row (the columns to carry), n_words, runs (start, length, period, by start and period) and collapsed, the kept words
    joined by a space, of every text."""
    rows = docs.select(F.struct(*carried).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for documents in chunks(b.column(1)):
                found = repetitions(documents, least)
                columns = [
                    pa.array([len(w) for w in documents], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for runs, _ in found], run_type),
                    pa.array([b" ".join(w if not len(runs) else [w[i] for i in np.flatnonzero(kept)]).decode() for w, (runs, kept) in zip(documents, found)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(documents)), *columns], ["row", "n_words", "runs", "collapsed"])
                at += len(documents)

    return rows.mapInArrow(run, f"row {kind}, n_words long, runs {RUNS}, collapsed string")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, in which one in ten ids has words from some place on that repeat with a period; both go by the id."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(x: Column) -> Column:
        n = F.size(x).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x, at(i).cast("int"))), " ")

    # the array is bound once, not made anew for each word
    planted = F.get(F.transform(F.array(words), changed), F.lit(0))
    return F.when((h % 10 == 0) & (bare != ""), planted).otherwise(text)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = periodic(docs).select("row.doc_id", "runs", F.array_min(ranked).alias("best"), lines.alias("lines"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
