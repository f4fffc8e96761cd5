import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import codes

KIND = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts=8, entries=16, rounds=6):
    """Plain Python over all pairs; rows of vec_id, embedding and label."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept else 0
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in kept if len(v) == width]
    cuts = [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cuts]
    apart = lambda x, y: sum((s - t) ** 2 for s, t in zip(x, y))

    def nearest(v, book):
        return min((apart(v, e), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for (a, b), book in zip(cuts, books):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[nearest(v[a:b], book)[1]].append(v[a:b])
            for i, got in own.items():
                book[i] = [sum(x) // len(got) for x in zip(*got)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(i, y, [nearest(v[a:b], book) for (a, b), book in zip(cuts, books)]) for i, v, y in kept]
    errors = collections.Counter()
    for _, y, near in found:
        errors[y] += sum(d for d, _ in near)
    most = (1 << 63) - 1
    return [(i, "".join(f"{e:02x}" for _, e in near), min(sum(d for d, _ in near), most), min(errors[y], most), digest) for i, y, near in found]


def table(spark, path, rows):
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("code", "error", "_label", "vectors", "trees")})
    df.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in codes.op11_codes(spark, str(path)).collect()), key=str)


def points(seed, n, width, kind):
    rnd = np.random.default_rng(seed)
    if kind == "clusters":
        return (rnd.normal(size=(7, width))[rnd.integers(0, 7, n)] + 0.1 * rnd.normal(size=(n, width))).astype(np.float32)
    if kind == "grid":  # many ties
        return rnd.integers(-2, 3, (n, width)).astype(np.float32) / 4096
    return rnd.normal(size=(n, width)).astype(np.float32)


@pytest.mark.parametrize("kind", ["clusters", "grid", "noise"])
def test_query_by_brute_force(spark, tmp_path, kind):
    x = points(5, 700, 64 if kind == "noise" else 16, kind).tolist()
    rows = [(1000 - i, v, (i % 5) or None) for i, v in enumerate(x)]
    rows += [(5000 + i, x[0], 3) for i in range(300)]  # a very common vector
    assert table(spark, tmp_path, rows) == sorted(by_hand(rows), key=str)


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(2)
    vec = lambda n: [rnd.uniform(-2, 2) for _ in range(n)]
    f32 = lambda v: np.array(v, np.float32).tolist()
    rows = [(i, f32(vec(11)), i % 2) for i in range(40)]  # not a multiple of the parts
    rows += [(50, None, 1), (51, f32(vec(11)), None), (51, rows[3][1], None), (51, rows[3][1], None), (None, rows[4][1], 1), (52, [], 1), (53, f32(vec(5)), 1)]
    rows += [(60, [float("nan")] * 11, 0), (61, [*rows[0][1][:10], float("inf")], 0), (62, [*rows[0][1][:10], None], 0), (63, f32([1e30] * 11), 7), (64, f32([-7e4] * 11), 7)]
    assert table(spark, tmp_path, rows) == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5, 0.25], 1), (2, [-0.5, 0.25], None)]])
def test_few_rows(spark, tmp_path, rows):
    assert table(spark, tmp_path, rows) == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("kind", ["clusters", "grid", "noise"])
def test_trees(kind):
    """Balls hold their points, cache their sums, and are owned or compared so that every point is counted once."""
    x = codes.scaled(points(3, 900, 8, kind))
    tree = codes.grown(x)
    assert sorted(tree.order.tolist()) == list(range(900)) and len(tree.start) == 2 * (tree.left < 0).sum() - 1
    for i in range(len(tree.start)):
        own = x[tree.order[tree.start[i] : tree.stop[i]]]
        assert (tree.sums[i] == own.sum(0)).all() and (np.sqrt(((own - tree.center[i]) ** 2).sum(1)) <= tree.radius[i] * (1 + 1e-9) + 1e-9).all()
        if tree.left[i] >= 0:
            assert sorted((tree.start[tree.left[i]], tree.start[tree.right[i]]))[0] == tree.start[i] and len(own) == sum(tree.stop[k] - tree.start[k] for k in (tree.left[i], tree.right[i]))
    again = codes.unpacked_tree(codes.packed_tree(tree), x)
    assert (again.sums == tree.sums).all() and (again.center == tree.center).all()
    entries = x[:16]
    which, away = codes.nearest(again, x, entries)
    full = codes.squared(x, entries)
    assert (which == full.argmin(1)).all() and (away == full.min(1)).all()
    sums, counts = codes.totals(again, x, entries)
    assert (counts == np.bincount(which, minlength=16)).all() and all((sums[e] == x[which == e].sum(0)).all() for e in range(16))


def test_owned_balls_spare_their_points():
    x = codes.scaled(points(3, 1000, 8, "clusters"))
    tree, met = codes.grown(x), []
    entries = np.stack([x[i : i + 50].mean(0).astype(int) for i in range(0, 800, 50)])
    centers = codes.scaled(np.random.default_rng(3).normal(size=(7, 8)).astype(np.float32))
    for e in (entries, centers):
        met.append(0)

        def compared(own, _):
            met[-1] += len(own)

        codes.descended(tree, x, e, lambda *_: None, compared)
    assert met[1] < 100 and met[0] <= 1000


def test_codes_stand_for_vectors(spark):
    x = points(9, 2000, 32, "clusters")
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND)
    codec, blocks = codes.learned(df)
    rows = codes.coded(blocks, codec, {"vec_id": "bigint", "label": "int"}).collect()
    apart = sum(((codec.decoded(r.code) - x[r.vec_id]) ** 2).sum() for r in rows)
    assert len(rows) == 2000 and apart < 0.1 * ((x - x.mean(0)) ** 2).sum()
