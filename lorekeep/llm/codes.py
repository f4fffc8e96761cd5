"""Compression of vectors to codes, learned exactly with metric trees.

Vectors are cut into parts; each part has a codebook of a few entries, and a vector's code names each part's nearest entry.
Codebooks are learned by rounds of assigning all parts and taking the means of what each entry got, all in integers, so the
result doesn't depend on how rows are dealt.

Rows lie in blocks. Of each block and part a metric tree is built once, middle-out: anchors, each taking from the others
the points that are nearer to it (an anchor's points are in order of distance, so that most aren't looked at), then balls
joined upwards by the least radius, and the same again within each anchor down to small leaves. Balls cache the sums and
counts of their points. A round goes down the tree level by level with the entries that can still own a point of the ball,
inherited from the ball above; an entry is dropped when a plane between it and the nearest one leaves the whole ball on the
other side. A ball with one entry left is owned by it: its cached sum and count are added and nothing below is visited. Only
points of leaves with several entries left are compared one by one, in integers.

What meets in a shuffle is one row for each part, entry and component of each partition; what comes to the driver is the
codebooks.

Defined cases: vectors that are null or hold null or non-finite components are left out, as are those of another length than
the vector with the least id; parts of a length that isn't a multiple of their number differ by one component, and parts
without any have error 0; with fewer vectors than entries there are as many entries as vectors; null ids come last; rows
that are repeated or share an id are vectors of their own, which tie by their components; components beyond 2^26 / 4096 and
parts of more than 256 components are compared in unbounded integers, and an error that a long can't hold is the greatest long; very long vectors need memory for
one block of them; ties between entries go to the lower index; an empty table gives an empty result; further columns with
any names are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and points of a leaf, at most.
BLOCK, LEAF = 1024, 24
#: Components from here on, or parts of more than 256 of them, are compared in unbounded integers.
MOST, WIDEST = 1 << 26, 256
MOST_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Balls, each above those it is made of; ball i holds the points order[start[i] : stop[i]]."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @property
    def root(self) -> int:
        return len(self.start) - 1


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Indexes of the points of each anchor. Each new anchor is the point that is furthest from its own."""
    away = np.sqrt(((points - points[0]) ** 2).sum(1))
    order = np.argsort(-away, kind="stable")
    pivots, owned, distances = [points[0]], [order], [away[order]]
    while len(pivots) < wanted:
        widest = max(range(len(owned)), key=lambda i: distances[i][0])
        if distances[widest][0] <= 0:
            break
        pivot = points[owned[widest][0]]
        between = np.sqrt(((np.stack(pivots) - pivot) ** 2).sum(1))
        taken, taken_away = [], []
        for i, own in enumerate(owned):
            far = int(np.searchsorted(-distances[i], -between[i] / 2, side="right"))  # nearer ones can't be nearer to the new pivot
            if not far:
                continue
            new = np.sqrt(((points[own[:far]] - pivot) ** 2).sum(1))
            goes = new < distances[i][:far]
            if goes.any():
                taken.append(own[:far][goes])
                taken_away.append(new[goes])
                stays = np.append(~goes, np.ones(len(own) - far, bool))
                owned[i], distances[i] = own[stays], distances[i][stays]
        own, away = np.concatenate(taken), np.concatenate(taken_away)
        order = np.argsort(-away, kind="stable")
        pivots.append(pivot)
        owned.append(own[order])
        distances.append(away[order])
    return owned


def grown(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of a block's points, which are integers."""
    real = points.astype(np.float64)
    n, width = real.shape
    nodes: list[tuple[int, int, np.ndarray, np.ndarray, float]] = []  # left, right, points, center, radius

    def ball(left: int, right: int, own: np.ndarray) -> int:
        center = real[own].mean(0)
        nodes.append((left, right, own, center, float(np.sqrt(((real[own] - center) ** 2).sum(1).max()))))
        return len(nodes) - 1

    def build(own: np.ndarray) -> int:
        if len(own) <= leaf or (real[own] == real[own[0]]).all():
            return ball(-1, -1, own)
        groups = anchors(real[own], max(2, math.isqrt(len(own))))
        return joined([build(own[g]) for g in groups])

    def joined(balls: list[int]) -> int:
        """Joins, again and again, the two balls whose bound on a common radius is least."""
        count = 2 * len(balls) - 1
        centers, radii = np.zeros((count, width)), np.zeros(count)
        ids = [*balls, *[-1] * (count - len(balls))]
        for i, b in enumerate(balls):
            centers[i], radii[i] = nodes[b][3], nodes[b][4]
        cost, alive = np.full((count, count), np.inf), np.zeros(count, bool)

        def met(i: int) -> None:
            others = np.flatnonzero(alive)
            apart = np.sqrt(((centers[others] - centers[i]) ** 2).sum(1))
            cost[i, others] = cost[others, i] = apart + radii[others] + radii[i]
            alive[i] = True

        for i in range(len(balls)):
            met(i)
        for i in range(len(balls), count):
            a, b = divmod(int(cost.argmin()), count)
            ids[i] = ball(ids[a], ids[b], np.concatenate([nodes[ids[a]][2], nodes[ids[b]][2]]))
            alive[[a, b]] = False
            cost[[a, b], :] = cost[:, [a, b]] = np.inf
            centers[i], radii[i] = nodes[ids[i]][3], nodes[ids[i]][4]
            met(i)
        return ids[-1]

    root = build(np.arange(n))
    start, stop = np.zeros(len(nodes), np.int32), np.zeros(len(nodes), np.int32)
    start[root], stop[root] = 0, n
    order = np.zeros(n, np.int32)
    for i in reversed(range(len(nodes))):  # a ball is made after its parts, and the root last
        left, right, own = nodes[i][:3]
        if left < 0:
            order[start[i] : stop[i]] = own
        else:
            start[left], stop[left] = start[i], start[i] + len(nodes[left][2])
            start[right], stop[right] = stop[left], stop[i]
    sums = np.stack([points[own].sum(0) for _, _, own, _, _ in nodes])
    left, right = (np.array([x[i] for x in nodes], np.int32) for i in (0, 1))
    return Tree(order, start, stop, left, right, np.stack([x[3] for x in nodes]), np.array([x[4] for x in nodes]), sums)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer points to integer entries, exact."""
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)


Visit = Callable[[np.ndarray, np.ndarray], None]


def descended(tree: Tree, points: np.ndarray, entries: np.ndarray, owned: Visit, compared: Visit) -> None:
    """Goes down the tree with shrinking lists of entries. Calls owned(balls, entries) for balls with one entry left, and
    compared(points, entries) for points of leaves, each with its nearest entry."""
    real = entries.astype(np.float64)
    size = (real**2).sum(1)
    between = np.sqrt(((real[:, None] - real[None]) ** 2).sum(2))
    balls, lists = np.array([tree.root]), np.ones((1, len(entries)), bool)
    while len(balls):
        center, radius = tree.center[balls], tree.radius[balls]
        products = center @ real.T
        near = np.where(lists, size - 2 * products, np.inf)
        best = near.argmin(1)
        # of any point x of the ball, |x - best|^2 - |x - e|^2 is at most this
        most = 2 * (products - products[np.arange(len(balls)), best][:, None]) + (size[best][:, None] - size) + 2 * radius[:, None] * between[best]
        slack = 1e-9 * (size[best][:, None] + size + (center**2).sum(1)[:, None] + (radius**2)[:, None] + 1)
        lists &= ~(most < -slack)
        lists[np.arange(len(balls)), best] = True
        one = lists.sum(1) == 1
        if one.any():
            owned(balls[one], best[one])
        leaf = ~one & (tree.left[balls] < 0)
        for b, allowed in zip(balls[leaf], lists[leaf]):
            own, left_over = tree.order[tree.start[b] : tree.stop[b]], np.flatnonzero(allowed)
            compared(own, left_over[squared(points[own], entries[left_over]).argmin(1)])
        down = ~one & (tree.left[balls] >= 0)
        balls, lists = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.concatenate([lists[down], lists[down]])


def totals(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums and counts of what each entry owns."""
    sums, counts = np.zeros(entries.shape, points.dtype), np.zeros(len(entries), np.int64)

    def owned(balls: np.ndarray, which: np.ndarray) -> None:
        np.add.at(sums, which, tree.sums[balls])
        np.add.at(counts, which, tree.stop[balls] - tree.start[balls])

    def compared(own: np.ndarray, which: np.ndarray) -> None:
        np.add.at(sums, which, points[own])
        np.add.at(counts, which, 1)

    descended(tree, points, entries, owned, compared)
    return sums, counts


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry and its squared distance."""
    out = np.zeros(len(points), np.int64)

    def owned(balls: np.ndarray, which: np.ndarray) -> None:
        for b, e in zip(balls, which):
            out[tree.order[tree.start[b] : tree.stop[b]]] = e

    def compared(own: np.ndarray, which: np.ndarray) -> None:
        out[own] = which

    descended(tree, points, entries, owned, compared)
    return out, ((points - entries[out]) ** 2).sum(1)


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * i // parts, width * (i + 1) // parts) for i in range(parts)]


def exact(points: np.ndarray) -> np.ndarray:
    """As unbounded integers if 64 bits may not do."""
    large = points.dtype != object and points.size and (points.shape[1] > WIDEST or np.abs(points).max() >= MOST)
    return points.astype(object) if large else points


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers; rows of Python integers if they are large."""
    x = values.astype(np.float64) * scale
    if x.size and np.abs(x).max() >= MOST:
        return np.array([[math.floor(v) if math.isfinite(v) else math.floor(w) * scale for v, w in zip(r, s)] for r, s in zip(x.tolist(), values.tolist())], object)
    return np.floor(x).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding, as doubles, of vectors that are there and hold finite numbers only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)


TREE = pa.struct([(f, pa.binary()) for f in ("order", "start", "stop", "left", "right", "center", "radius")])


def packed_tree(tree: Tree) -> dict[str, bytes]:
    return {f.name: getattr(tree, f.name).tobytes() for f in TREE}


def unpacked_tree(packed: dict[str, bytes], points: np.ndarray) -> Tree:
    """The tree, with its balls' sums from those of the points in its order."""
    kinds = {"center": np.float64, "radius": np.float64}
    x = {k: np.frombuffer(v, kinds.get(k, np.int32)) for k, v in packed.items()}
    running = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points[x["order"]], axis=0)])
    x["center"] = x["center"].reshape(len(x["start"]), points.shape[1])
    return Tree(**x, sums=running[x["stop"]] - running[x["start"]])


def in_blocks(rows: DataFrame, width: int, parts: int = PARTS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of rows: their ids, labels and vectors, and a tree for each part; written."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        vectors = np.array(whole["embedding"].to_pylist(), np.float64).reshape(whole.num_rows, width)
        points = scaled(vectors, scale)
        trees = [packed_tree(grown(points[:, a:b], leaf)) for a, b in cuts(width, parts)]
        lists = [pa.array([whole[c].to_pylist()], pa.list_(whole.schema.field(c).type)) for c in ("vec_id", "label")]
        columns = [*lists, pa.array([vectors.tobytes()], pa.binary()), pa.array([trees], pa.list_(TREE))]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vectors", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                piece = whole.slice(at, block - n)
                held, n, at = [*held, piece], n + piece.num_rows, at + piece.num_rows
                if n == block:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    tree = ", ".join(f"{f.name}: binary" for f in TREE)
    kind = f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, vectors binary, trees array<struct<{tree}>>"
    return written(rows.select("vec_id", "label", "embedding").mapInArrow(run, kind))


def blocks_of(batch: pa.RecordBatch, width: int, parts: int, scale: int) -> Iterator[tuple[list, list, list[tuple[np.ndarray, Tree]]]]:
    """ids, labels and each part's points and tree, of each block."""
    for i in range(batch.num_rows):
        points = scaled(np.frombuffer(batch.column(2)[i].as_py(), np.float64).reshape(-1, width), scale)
        found = []
        for (a, b), packed in zip(cuts(width, parts), batch.column(3)[i].as_py()):
            own = exact(points[:, a:b])
            found.append((own, unpacked_tree(packed, own)))
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), found


def as_entries(book: list[list[int]]) -> np.ndarray:
    large = any(abs(v) >= MOST for e in book for v in e)
    return exact(np.array(book, object if large else np.int64).reshape(len(book), len(book[0]) if book else 0))


Books = list[list[list[int]]]


def first_entries(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE) -> tuple[Books, int]:
    """Each part's codebook of the vectors with the least ids, and the vectors' length."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = least.select("embedding").first()
    width = len(first["embedding"]) if first else 0
    found = least.where(F.size("embedding") == width).limit(entries).select("embedding").collect() if width else []
    points = scaled(np.array([r["embedding"] for r in found], np.float64).reshape(len(found), width), scale)
    return [[[int(v) for v in p[a:b]] for p in points] for a, b in cuts(width, parts)], width


def improved(blocks: DataFrame, books: Books, width: int, parts: int = PARTS, scale: int = SCALE) -> Books:
    """The codebooks after one more round; entries that own nothing stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [as_entries(b) for b in books]
        sums = [np.zeros(e.shape, object) for e in entries]
        counts = [np.zeros(len(e), np.int64) for e in entries]
        for batch in batches:
            for _, _, found in blocks_of(batch, width, parts, scale):
                for k, (points, tree) in enumerate(found):
                    s, c = totals(tree, points, entries[k])
                    sums[k], counts[k] = sums[k] + s, counts[k] + c
        out = [(k, e, d, str(v), int(n)) for k in range(parts) for e, n in enumerate(counts[k]) if n for d, v in enumerate(sums[k][e])]
        names = ["part", "entry", "component", "sum", "count"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    got = blocks.mapInArrow(run, "part int, entry int, component int, sum string, count long")
    total = F.sum(F.col("sum").cast("decimal(38,0)")).cast("string").alias("sum")
    out = [[list(e) for e in book] for book in books]
    for r in got.groupBy("part", "entry", "component").agg(total, F.sum("count").alias("count")).collect():
        out[r["part"]][r["entry"]][r["component"]] = int(r["sum"]) // r["count"]
    return out


@dataclass(frozen=True)
class Codec:
    """Learned codebooks: by part, entry and component."""

    books: Books
    width: int
    scale: int = SCALE

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for e in book for v in e).encode()).hexdigest()

    def decoded(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.array([v for i, book in enumerate(self.books) for v in book[int(code[2 * i : 2 * i + 2], 16)]], np.float64) / self.scale


def coded(blocks: DataFrame, codec: Codec, kinds: dict[str, str]) -> DataFrame:
    """vec_id, label, code and error of all rows."""
    parts = len(codec.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [as_entries(b) for b in codec.books]
        for batch in batches:
            for ids, labels, found in blocks_of(batch, codec.width, parts, codec.scale):
                codes, error = [], 0
                for k, (points, tree) in enumerate(found):
                    which, away = nearest(tree, points, entries[k])
                    codes.append(which)
                    error = error + away
                texts = ["".join(f"{v:02x}" for v in r) for r in np.stack(codes, 1).tolist()]
                columns = [pa.array(ids, batch.schema.field("vec_id").type.value_type), pa.array(labels, batch.schema.field("label").type.value_type)]
                columns += [pa.array(texts, pa.string()), pa.array([min(int(v), MOST_LONG) for v in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def learned(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codec, DataFrame]:
    """A codec of these vectors (vec_id, label, embedding), and their rows in blocks with trees, for `coded`."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    rows = usable(vectors)
    books, width = first_entries(rows, entries, parts, scale)
    blocks = in_blocks(rows.where(F.size("embedding") == width) if width else rows.limit(0), width, parts, scale)
    for _ in range(rounds if width else 0):
        books = improved(blocks, books, width, parts, scale)
    return Codec(books, width, scale), blocks


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codec, blocks = learned(vectors)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    # nulls together, and apart from every label
    rows = written(coded(blocks, codec, kinds).withColumn("_label", F.coalesce(F.concat(F.lit("+"), F.col("label").cast("string")), F.lit("-"))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG)).cast("long")
    sums = rows.groupBy("_label").agg(total.alias("label_error"), F.count("*").alias("_n"))
    sums = written(sums)
    out = spread_join(rows, sums.drop("_n"), "_label", ["vec_id", "code"], sums)
    return out.select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Rounds of assignment and means, by all pairs of parts and entries."""
    near = "(SELECT p.id, p.part, min({d} * 16 + b.entry) AS key FROM parts p JOIN {book} b ON b.part = p.part GROUP BY p.id, p.part)"
    apart = "list_sum([(p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]])"
    out = []
    for i in range(ROUNDS):
        out.append(f"n{i} AS {near.format(d=apart, book=f'b{i}')}")
        out.append(
            f"m{i} AS (SELECT p.part, n.key % 16 AS entry, c.c, sum(p.v[c.c]) AS s, count(*) AS n FROM parts p JOIN n{i} n USING (id, part), (SELECT unnest(range(1, 9)) AS c) c GROUP BY ALL), "
            f"v{i} AS (SELECT part, entry, list((CAST(s - ((s % n) + n) % n AS HUGEINT) // n)::BIGINT ORDER BY c) AS v FROM m{i} GROUP BY part, entry), "
            f"b{i + 1} AS (SELECT b.part, b.entry, coalesce(v.v, b.v) AS v FROM b{i} b LEFT JOIN v{i} v USING (part, entry))"
        )
    out.append(f"last AS {near.format(d=apart, book=f'b{ROUNDS}')}")
    return ",\n".join(out)


#: For vectors of 64 components.
OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, [CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (SELECT id, part, v[part * 8 + 1 : part * 8 + 8] AS v FROM kept, (SELECT unnest(range(0, {PARTS})) AS part)),
b0 AS (SELECT part, id - 1 AS entry, v FROM parts WHERE id <= {ENTRIES}),
{_rounds_sql()},
rows AS (
  SELECT id, string_agg(printf('%02x', key % 16), '' ORDER BY part) AS code, CAST(sum(key // 16) AS BIGINT) AS error FROM last GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN rows USING (id)
"""
