import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import periods

from .conftest import KIND, prose


def runs_by_hand(words, least=12):
    """Every period's maximal stretches, the least period of each stretch alone."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in dropped]


def strings(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        letters = rnd.choice(["ab", "abc", "aab", "abcdef"])
        n = rnd.randint(0, 90)
        x = rnd.choices(letters, k=n)
        if rnd.random() < 0.5 and n:  # powers and nearly powers
            unit = rnd.choices(letters, k=rnd.randint(1, 9))
            unit = unit * rnd.randint(1, 4) + rnd.choices(letters, k=rnd.randint(0, 2))
            at = rnd.randrange(n)
            x = x[:at] + unit * rnd.randint(2, 5) + unit[: rnd.randrange(len(unit) + 1)] + x[at:]
        yield [w.encode() for w in x]
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    yield [w.encode() for w in b]  # a Fibonacci word has as many runs as words nearly
    yield [b"x"] * 1000
    yield [b"x", b"y"] * 300 + [b"x"] * 300 + [b"x", b"y"] * 300


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [2, 12])
def test_runs_by_brute_force(seed, least):
    documents = list(strings(seed))
    for words, (runs, kept) in zip(documents, periods.repetitions(documents, least)):
        want = runs_by_hand(words, least)
        assert [tuple(r) for r in runs.tolist()] == want
        assert [w for w, k in zip(words, kept) if k] == collapsed_by_hand(words, want)


def test_few_proposals_on_periodic_words():
    words = np.array(list(range(50)) * 400, np.int64)
    levels, where, _ = periods.levels_of(words)
    assert len(levels) == 15 and len(where) <= 4 * len(levels)


def row_by_hand(doc, text):
    words = (text or "").encode().split()
    h, n = None if doc is None else zlib.crc32(str(doc).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return doc, len(runs), s, m, q, 1000 * m // q if runs else None, sha(lines), sha(b" ".join(collapsed_by_hand(words, runs)))


def test_query_by_brute_force(spark, odd_rows, tmp_path):
    rnd = random.Random(3)
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000]
    rows += [(1000 + i, prose(rnd, rnd.randint(0, 150), "ab"), "en", "s", 1) for i in range(150)]
    rows += [(2000 + i, " \t".join(rnd.choices(["x", "y é", "z\r\n"], k=60)) + "\n", "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("row", "runs", "collapsed", "n_words")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periods.op13_periods(spark, str(tmp_path)).collect()), key=str)
    want = sorted((row_by_hand(d, t) for d, t, *_ in rows), key=str)
    assert got == want and sum(r[1] > 0 for r in want) > 40 and any(r[1] > 1 for r in want)


def test_operator_on_odd_and_empty_tables(spark, odd, odd_rows, none):
    got = periods.periodic(odd, odd.columns).collect()
    assert len(got) == len(odd_rows) and all(r.row["size"] == "x" for r in got)
    for r in got:
        words = (r.row.text or "").split(" ") if r.row.doc_id == 6 else (r.row.text or "").encode().split()
        assert r.n_words == len(words) and r.collapsed is not None and (r.runs or not words or len(r.collapsed) > 0)
    assert periods.periodic(none).isEmpty()
    long = spark.createDataFrame([(1, "a b c " * 100_000 + "d " * 400_000)], "doc_id long, text string")
    r = periods.periodic(long).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 3), (300_000, 400_000, 1)] and r.collapsed == "a b c d"
