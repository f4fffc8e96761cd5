import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.stemmer import stem
from lorekeep.operators import bm25, index

KIND = "conversation_id string, id long, lexemes array<string>"
ASKED = "query_id string, conversation_id string, lexemes array<string>"


def scores_by_hand(docs, queries, k1=1.2, b=0.75):
    """query_id to its documents and scores, the best first."""
    out = {}
    for q, conv, lex in queries:
        own = [(i, d) for c, i, d in docs if c == conv and c is not None]
        sizes = [len(d or ()) for _, d in own]
        average = sum(sizes) / len(own) if own else 0
        df = collections.Counter(t for _, d in own for t in set(d or ()))
        found = []
        for i, d in own:
            tf, total = collections.Counter(d or ()), 0.0
            for t in lex:
                if tf[t]:
                    total += math.log1p((len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / average))
            if total:
                found.append((i, round(total, 9)))
        out[q] = sorted(found, key=lambda x: (-x[1], x[0]))
    return out


def tables(spark, seed, topics=1):
    rnd = random.Random(seed)
    words = [[f"t{t}w{i}" for i in range(25)] for t in range(topics)]
    docs, queries = [], []
    for i in range(240):
        own = words[i * topics // 240]
        docs.append((f"c{i % 3}" if topics == 1 else "c0", i, [rnd.choice(own) for _ in range(rnd.randint(0, 30))]))
    docs += [("c1", 500, None), ("c1", 501, []), (None, 502, ["t0w1"]), ("c1", 503, docs[1][2]), ("c1", 504, docs[1][2])]
    for i in range(30):
        queries.append((f"q{i}", f"c{i % 4}" if topics == 1 else "c0", [rnd.choice(words[i % topics]) for _ in range(rnd.randint(1, 6))] + ["unknown"] * (i % 2)))
    queries.append(("none", "c1", []))
    return docs, queries, spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(queries, ASKED)


@pytest.mark.parametrize("n", [0, 1, 4])
def test_equal_to_the_full_sum(spark, tmp_path, n):
    docs, queries, corpus, asked = tables(spark, n)
    made = index.build(corpus, f"file://{tmp_path}/index", documents=7, most=90)
    assert made.blocks().count() > 30 and made.blocks().select(F.max(F.size("ids"))).first()[0] <= 7
    want = scores_by_hand(docs, queries)
    got = collections.defaultdict(list)
    for r in index.search(made, asked, n).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, round(r.score, 9)))
        assert r.rank == len(got[r.query_id])
    assert got == {q: x[: n or None] for q, x in want.items() if x}
    assert {(r.conversation_id, r.term, r.df) for r in made.document_frequency().where("conversation_id is not null").select("conversation_id", "term", "df").collect()} == {
        (c, t, k) for c in ("c0", "c1", "c2") for t, k in collections.Counter(t for x, _, d in docs if x == c for t in set(d or ())).items()
    }
    other = scores_by_hand(docs, queries, 0.4, 0.1)
    again = {(r.query_id, r.id): round(r.score, 9) for r in index.search(made, asked, 0, 0.4, 0.1).collect()}
    assert again == {(q, i): s for q, x in other.items() for i, s in x}


def test_blocks_are_skipped_and_counted(spark, tmp_path):
    """Documents of one topic lie together: blocks of the others aren't even candidates, and of its own some are skipped."""
    docs, queries, corpus, asked = tables(spark, 5, topics=6)
    made = index.build(corpus.coalesce(1), f"file://{tmp_path}/index", documents=5)
    report = {r.query_id: r for r in index.search(made, asked, 1, report=True).collect()}
    assert sum(r.skipped for r in report.values()) > 50 and all(0 <= r.skipped < r.blocks <= 10 for r in report.values())
    want = scores_by_hand(docs, queries)
    assert {r.query_id: r.id for r in index.search(made, asked, 1).collect()} == {q: x[0][0] for q, x in want.items() if x}


def test_competitive_pairs_bound_every_document(spark, tmp_path):
    _, _, corpus, _ = tables(spark, 9)
    made = index.build(corpus, f"file://{tmp_path}/index", documents=20)
    lengths = {(r.conversation_id, r.block): r.lengths for r in made.blocks().collect()}
    for r in made.terms().collect():
        pairs = list(zip(r.best_counts, r.best_lengths))
        own = [(c, lengths[r.conversation_id, r.block][p]) for p, c in zip(r.places, r.counts)]
        assert set(pairs) <= set(own) and all(any(c >= x and m <= y for c, m in pairs) for x, y in own)
        assert not any(a != b and a[0] >= b[0] and a[1] <= b[1] for a in pairs for b in pairs)


def test_stems_are_of_the_index(spark, tmp_path):
    words = ["running", "runs", "run", "dogs", "dog", "happily", "happy", "be"]
    rnd = random.Random(1)
    docs = [("c", i, [rnd.choice(words) for _ in range(9)]) for i in range(40)]
    made = index.build(spark.createDataFrame(docs, KIND), f"file://{tmp_path}/index", stemmed=True, documents=8)
    stems = [(c, i, [stem(w) for w in d]) for c, i, d in docs]
    queries = [("a", "c", ["run"]), ("b", "c", ["dog", stem("happy")])]
    got = {(r.query_id, r.id): round(r.score, 9) for r in index.search(made, spark.createDataFrame(queries, ASKED)).collect()}
    assert got == {(q, i): s for q, x in scores_by_hand(stems, queries).items() for i, s in x}


def test_a_stored_index_is_opened_again_until_its_files_change(spark, tmp_path):
    _, _, corpus, asked = tables(spark, 2)
    path, store, built = f"file://{tmp_path}/in", f"file://{tmp_path}/store", []

    def corpus_of():
        built.append(1)
        return spark.read.parquet(path)

    corpus.write.parquet(path)
    opened = lambda **how: index.stored_index(spark, spark.read.parquet(path), "x", corpus_of, store=store, **how)
    first, second = opened(), opened()
    assert len(built) == 1 and first.folder == second.folder
    rows = lambda i: sorted(map(str, index.search(i, asked, 3).collect()))
    assert rows(first) == rows(second)
    assert opened(stemmed=True).folder != first.folder and len(built) == 2
    corpus.limit(10).write.mode("append").parquet(path)
    assert opened().folder != first.folder and len(built) == 3


def test_an_empty_corpus(spark, tmp_path):
    _, _, corpus, asked = tables(spark, 3)
    made = index.build(corpus.limit(0), f"file://{tmp_path}/index")
    assert index.search(made, asked, 3).isEmpty() and bm25.bm25(corpus, asked.limit(0), 3).isEmpty()
