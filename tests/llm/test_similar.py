"""Groups of near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from lorekeep.llm import similar, simhash

from .conftest import prose


def edited(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = "".join(rnd.choices("uvwxyz", k=9))
    return " ".join(words)


def by_hand(rows):
    """The least id of what pairs that share 0.8 of their shingles, or SimHash's, connect."""
    ids = [i for i, _ in rows]
    sets = [set(similar.shingle_hashes(t).tolist()) for _, t in rows]
    prints = [simhash.fingerprint(t, 3) for _, t in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            both = len(sets[p] & sets[q])
            if both >= 0.8 * (len(sets[p]) + len(sets[q]) - both) or ((prints[p] ^ prints[q]) & (2**64 - 1)).bit_count() <= 2:
                a, b = sorted((find(ids[p]), find(ids[q])))
                root[b] = a
    return {i: find(i) for i in ids}


def groups(spark, rows):
    return {r.doc_id: r.group_id for r in similar.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_original_with_many_edited_copies(spark):
    """Each copy is like the original and unlike the other copies."""
    rnd = random.Random(5)
    base = prose(rnd, 400).split()
    rows = [(0, " ".join(base))] + [(1 + i, edited(rnd, base, 7)) for i in range(1000)]
    want = by_hand(rows)
    assert sum(x == 0 for x in want.values()) > 990
    assert groups(spark, rows) == want


@pytest.mark.parametrize("block", [1024, 40])
def test_members_that_are_not_like_the_leader(spark, monkeypatch, block):
    """A long passage that many share crowds bands; pairs, and a chain of copies, are only like one another."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar.cells, "__defaults__", (block,))
    rnd = random.Random(6)
    passage = prose(rnd, 300).split()
    rows, at = [], 0
    for i in range(120):
        own = passage + prose(rnd, 110).split()
        rows += [(at, " ".join(own)), (at + 1, edited(rnd, own, 5))]
        at += 2
    chain = passage + prose(rnd, 110).split()
    for i in range(6):
        rows.append((at + i, " ".join(chain)))
        chain = edited(rnd, chain, 6).split()
    want = by_hand(rows)
    assert len(set(want.values())) > 100
    got = groups(spark, rows)
    assert got == want


def test_links_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)]
    got = set(zip(*(x.tolist() for x in similar.links(sets[:15], sets[15:], 0.5))))
    assert got == {(i, j) for i in range(15) for j in range(25) if similar.jaccard(sets[i], sets[15 + j]) >= 0.5} and got
