"""Near-duplicates by shared word shingles: what the pipeline's near-dedup adds to SimHash.

Copies that share four fifths of their five-word shingles differ in 4 to 14 of 64 fingerprint bits, so a ball of 2 bits
finds next to none of them, and balls that would are beyond any shuffle (README has the figures). So the pipeline also
compares shingle sets themselves. Each distinct set is one class. Its minima under independent hash functions, taken four
at a time, are its bands. Classes that share a band are first compared with one of them, the one that shares most bands
with most others: by all their minima, then exactly, on the whole texts. Bands whose members are one component by then
are done. In any other band, each member outside its largest component is compared with all members: both are dealt to
blocks, a task holds one pair of blocks (a cell), finds the members with a likely partner by their minima, and another
compares those exactly and emits only links that join what the cell's earlier links don't. So all pairs that share a band
are compared, or connected already, while rows stay far from the square of a band's size. A pair at the least similarity
shares a band with probability 1 - (1 - 0.8^4)^12 = 0.998.

Defined cases: texts without a word are one class; fewer words than a shingle has are one shingle; repeated rows are of one
class; null ids belong to a class but can't name it; all shingles of a very long text are hashed at once, so it needs memory
for them; an empty table gives an empty result. Only the id and text columns are read, so others can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spread_join, written
from .simhash import deduplicated

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 12, 4
#: Pairs whose share of equal minima is less than this are left: at a true 0.8 that is over five deviations off.
LEAST_GUESS = 0.5
#: Members in a block; a cell is two blocks.
BLOCK = 1024
#: Shingles that are counted at once in a cell.
COLUMNS = 4096
_random = np.random.default_rng(20)
FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    k = min(shingle, len(words))
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(x)) for x in zip(*(words[i:] for i in range(k)))]), ">u8").astype(np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None] * FACTORS + SHIFTS
        out = np.minimum(out, (part ^ (part >> np.uint64(29))).min(axis=0))
    return out


def bands(least: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * FACTORS[:BANDS]
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * FACTORS[0]
        out ^= out >> np.uint64(31)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the shingle set) and minima (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [shingle_hashes(x.as_py()) for x in part.column(1)]
                keys = [xxhash.xxh128_digest(x.tobytes()) for x in sets]
                least = [minima(x).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "key", "minima"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key binary, minima array<long>")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bands(np.asarray(x, np.int64).view(np.uint64)).view(np.int64) for x in b.column(1).to_pylist()]
            at = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.concatenate(found) if found else [], pa.int64()), at], ["id", "band", "at"])

    return classes.where(F.size("minima") > 0).select("id", "minima").mapInArrow(run, "id long, band long, at int")


def met(classes: DataFrame) -> DataFrame:
    """id, band, at (the band's number), n and leader of classes that share a band. The leader is the member whose bands
    have the most members in all, so an original rather than a copy of it that was edited; ties by a hash."""
    rows = written(_banded(classes))
    counts = written(rows.groupBy("band").agg(F.count("*").alias("_n")))
    shared = written(spread_join(rows, counts.where("_n > 1").withColumnRenamed("_n", "n"), "band", counts=counts))
    weights = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    order = F.struct("weight", F.xxhash64("id", "band"))
    leaders = shared.select("id", "band").join(weights, "id").groupBy("band").agg(F.max_by("id", order).alias("leader"))
    return written(spread_join(shared, leaders, "band", counts=counts.where("_n > 1")))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of one document for each of `ids`."""
    # ids and pairs grow with the data, so they're merged at every size and never broadcast
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return written(named.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]))


def leader_pairs(docs: DataFrame, classes: DataFrame, shared: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): a member and a leader of its bands that share at least `least` of their shingles."""
    pairs = written(shared.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    joined = lambda pairs, rows, name, n: spread_join(pairs, rows(name), name, ["a", "b"], written(n.groupBy(name).agg(F.count("*").alias("_n"))), merge=True)
    side = lambda name: classes.select(F.col("id").alias(name), F.col("minima").alias(f"{name}_minima"))
    alike = F.aggregate(F.zip_with("a_minima", "b_minima", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    both = joined(joined(pairs, side, "a", pairs), side, "b", pairs)
    likely = written(both.where(alike >= LEAST_GUESS * BANDS * ROWS).select("a", "b"))
    texts = _texts(docs, likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
    text = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"))
    pairs = joined(joined(likely, text, "a", likely), text, "b", likely).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(shingle_hashes(x.as_py()), shingle_hashes(y.as_py())) >= least for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


CELL = ["band", "i", "j"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell; they come sorted, and the first three columns are the cell's."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(len(CELL))])
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for start, end in zip(starts, starts[1:]):
            if held and tuple(keys[start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = tuple(keys[start])
    if held:
        yield pa.Table.from_batches(held)


#: What a row of a cell is: a member of the band's largest component, another member, or another that is to meet all.
LARGEST, OTHER, ASKING = 0, 1, 2


def cells(shared: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """band, i, j, at, id, root, side: the members of each cell of bands that aren't one component by `roots`. Bands of
    two members are left out, as one is the leader of the other."""
    rows = shared.where("n > 2").select("id", "band", "at")
    rows = written(rows.join(roots, rows["id"] == roots["node"], "left").select("id", "band", "at", F.coalesce("root", "id").alias("root")))
    counts = rows.groupBy("band", "root").agg(F.count("*").alias("m")).groupBy("band")
    open_ = written(counts.agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("largest")))
    rows = written(spread_join(rows, open_.where("n > most"), "band", counts=open_.select("band", F.col("n").alias("_n"))).withColumn("other", F.col("root") != F.col("largest")))
    across, down = F.ceil((F.col("n") - F.col("most")) / block), F.ceil(F.col("n") / block)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asking = rows.where("other").withColumn("i", F.pmod(F.xxhash64("id", "band"), across)).withColumn("j", numbers(down)).withColumn("side", F.lit(ASKING))
    asked = rows.withColumn("i", numbers(across)).withColumn("j", F.pmod(F.xxhash64("id", "band"), down)).withColumn("side", F.when(F.col("other"), OTHER).otherwise(LARGEST))
    names = [*CELL, "at", "id", "root", "side"]
    return asking.select(names).unionByName(asked.select(names))


def likely(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of rows that agree in at least LEAST_GUESS of their columns."""
    same = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        same += a[:, None] == b[None, :]
    return np.nonzero(same >= LEAST_GUESS * BANDS * ROWS)


def promising(members: DataFrame, classes: DataFrame) -> DataFrame:
    """band, i, j, id, asks: what has a likely partner of another component in its cell. A pair counts in the first band
    that it shares, and there from the lesser id if both ask."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 16 bits of each minimum do, as unlike ones rarely agree and whatever is likely is compared exactly
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(x, np.int64).astype("<u2").tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            at, ids, roots, side = (cell.column(k).to_numpy() for k in range(3, 7))
            minima_ = np.frombuffer(b"".join(cell.column(7).to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
            asks, asked = np.flatnonzero(side == ASKING), np.flatnonzero(side != ASKING)
            a, b = likely(minima_[asks], minima_[asked])
            a, b = asks[a], asked[b]
            once = (roots[a] != roots[b]) & ((side[b] == LARGEST) | (ids[a] < ids[b]))
            a, b, found = a[once], b[once], np.zeros(len(ids), bool)
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                first = (minima_[x] == minima_[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == at[0]
                found[x[first]] = found[y[first]] = True
            some = cell.filter(pa.array(found)).combine_chunks()
            columns = [*(some.column(k).combine_chunks() for k in (0, 1, 2, 4)), pa.array(side[found] == ASKING)]
            yield pa.RecordBatch.from_arrays(columns, [*CELL, "id", "asks"])

    ids = members.select("id").distinct()
    cuts = classes.select("id", "minima").join(ids.hint("merge"), "id", "left_semi").mapInArrow(cut, "id long, cut binary")
    dealt = members.join(cuts.hint("merge"), "id").select(*CELL, "at", "id", "root", "side", "cut")
    return dealt.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "band long, i long, j long, id long, asks boolean")


def links(asking: list[np.ndarray], asked: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of all pairs of shingle sets that share at least `least` of their shingles."""
    sizes = np.array([len(x) for x in [*asking, *asked]])
    _, which, counts = np.unique(np.concatenate([*asking, *asked]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # only shingles of more than one set can be shared
    several = counts > 1
    column, keep = np.cumsum(several) - 1, several[which]
    order = np.argsort(column[which[keep]], kind="stable")
    owner, column = owner[keep][order], column[which[keep]][order]
    both = np.zeros((len(asking), len(asked)), np.float32)
    for start in range(0, int(several.sum()), COLUMNS):
        first, last = np.searchsorted(column, [start, start + COLUMNS])
        holds = np.zeros((len(sizes), COLUMNS), np.float32)
        holds[owner[first:last], column[first:last] - start] = 1
        both += holds[: len(asking)] @ holds[len(asking) :].T
    either = sizes[: len(asking), None] + sizes[None, len(asking) :] - both.astype(np.int64)
    return np.nonzero(both / np.maximum(either, 1) >= least)


def rest_pairs(docs: DataFrame, classes: DataFrame, shared: DataFrame, roots: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): links of all pairs of a band that `roots` doesn't connect and that share at least `least` of their shingles."""
    some = written(promising(cells(shared, roots), classes))
    texts = _texts(docs, some.select("id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            ids, asks = cell.column(3).to_numpy(), cell.column(4).to_numpy()
            hashes = [shingle_hashes(x.as_py()) for x in cell.column(5)]
            left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
            root, out = {int(x): int(x) for x in ids}, []

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y in zip(*links([hashes[k] for k in left], [hashes[k] for k in right], least)):
                a, b = int(ids[left[x]]), int(ids[right[y]])
                if (p := find(a)) != (q := find(b)):
                    root[p] = q
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

    dealt = some.hint("merge").join(texts, "id").select(*CELL, "id", "asks", "text")
    return dealt.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and group_id, the least id of what copies, SimHash links and shared shingles connect."""
    drawn = written(sketches(docs))
    classes = written(drawn.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("minima").alias("minima"), F.count("*").alias("_n")))
    told = classes.where("id is not null").select("id", "minima")
    shared = met(told)
    near = leader_pairs(docs, told, shared, least)
    members = written(spread_join(drawn.select("doc_id", "key"), classes.select("key", "id"), "key", counts=classes).select("doc_id", "id").distinct())
    prints = deduplicated(docs).select(F.col("doc_id").cast("long").alias("_doc"), F.col("component_id").cast("long").alias("b"))
    across = members.join(prints.distinct(), F.col("doc_id") == F.col("_doc")).select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    first = written(near.unionByName(across))
    roots = components(first)
    rest = written(rest_pairs(docs, told, shared, roots, least))
    if not rest.isEmpty():
        # what the first links connect is stars already
        roots = components(roots.toDF("a", "b").unionByName(rest))
    out = spread_join(members, roots.withColumnRenamed("node", "id"), "id", how="left")
    return out.select("doc_id", F.coalesce("root", "id").alias("group_id"))
