import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lorekeep.llm import packing, tokens

from .conftest import prose


def test_word_by_word_encoding_is_the_library_s():
    """On the driver's whole documents and on random code points."""
    encode = tokens.encoder(tokens.default_tokenizer())
    rnd = random.Random(5)
    texts = [x for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist() if x]
    ranges = [(32, 127), (32, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0x1F300, 0x1F700)]
    for _ in range(400):
        low, high = rnd.choice(ranges)
        texts.append("".join(chr(rnd.choice([rnd.randrange(low, high), rnd.randrange(32, 127), 32, 0x301])) for _ in range(60)))
    texts += ["İstanbul ΑΣ ὈΔΥΣΣΕΎΣ", "<|endoftext|> A<|B", "ÅÅ ﬁ K 'LL 'll don't", "a.b,, ,; x\u00a0y\u2028z"]
    for text in texts:
        want = encode.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == want


def test_neighbours_by_brute_force(spark):
    """The order of neighbours is that of BM25, computed rest by rest."""
    rnd = random.Random(3)
    name = tokens.default_tokenizer()
    rows = [(i, prose(rnd, rnd.randint(5, 60), "abc" if i % 2 else "cde")) for i in range(40)]
    table = packing.token_table(spark.createDataFrame(rows, "doc_id long, text string"), name)
    idf, mean = packing.term_weights(table, tokens.encoder(name).vocabulary)
    rests = [packing._array(r.ids, r.n) for r in table.where("n >= 0").orderBy("doc_id").collect()]
    shard = packing.Shard(rests, idf, mean)
    holds = [set(x.tolist()) for x in rests]
    assert mean == pytest.approx(np.mean([len(x) for x in rests]))
    for seed in (0, 7, 39):
        scores = []
        for x in rests:
            score = 0.0
            for term in holds[seed]:
                tf, df = int((x == term).sum()), sum(term in h for h in holds)
                score += np.log1p((40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
            scores.append(score)
        found = shard.neighbours(seed)
        assert seed not in found and len(found) == 39
        assert [scores[i] for i in found] == pytest.approx(sorted((scores[i] for i in found), reverse=True), rel=1e-5)


def test_only_a_partition_s_last_ids_are_in_short_windows(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randint(1, 400))) for i in range(300)] + [(None, None), (5, ""), (5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = packing.pack(docs, shard=16, with_ids=True).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes <= 4096).all() and (sizes < 4096).sum() <= 12
    assert all(n & (n - 1) == 0 for n in sizes)
    encode, key = tokens.encoder(tokens.default_tokenizer()), lambda x: (-1 if x is None else x)
    want = sorted((key(d), tuple(np.frombuffer(encode.encode(t), "<u4").tolist() + [2])) for d, t in rows)
    pieces = {}
    for doc, start, n, ids in sorted(zip(got.doc_id.fillna(-1), got.start, got.doc_tokens, map(tuple, got.ids))):
        pieces.setdefault(int(doc), []).append((start, n, ids))
    for d in {key(d) for d, _ in rows} - {5}:
        assert sum((p for _, _, p in pieces[d]), ()) == next(t for k, t in want if k == d)
    assert sum(len(p) for _, _, p in pieces[5]) == sum(len(t) for k, t in want if k == 5)
    for _, group in got.groupby("sequence_id"):
        ends = sorted(zip(group.offset, group.length))
        assert [a for a, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1]]


def test_terms_of_most_rests_are_indexed(spark):
    """On a table of one topic, where every term is in most rests, neighbours still go by what they share."""
    common_words = "the of and a in to"
    rows = [(i, " ".join([common_words] * (1 + i % 3 * 4))) for i in range(30)]
    name = tokens.default_tokenizer()
    table = packing.token_table(spark.createDataFrame(rows, "doc_id long, text string"), name)
    idf, mean = packing.term_weights(table, tokens.encoder(name).vocabulary)
    rest = np.frombuffer(tokens.encoder(name).encode(common_words), "<u4")
    assert len(rest) and (idf[rest] > 0).all()
    terms, values = packing.impacts(rest, idf, mean)
    assert set(terms.tolist()) == set(rest.tolist()) and (values > 0).all()


@pytest.mark.parametrize("together", [40, 1 << 23])
def test_words_of_many_texts_are_looked_up_once(monkeypatch, together):
    """Texts that are encoded together have the ids that each has alone."""
    monkeypatch.setattr(tokens, "TOGETHER", together)
    rnd = random.Random(6)
    texts = [None, "", " ", "\t\n\x0b\x0c\r", "a\x0bb\x0cc\x1cd\x1de\x85g\u00a0h\u2028i", "<|endoftext|> A B", "A<|B Ab", "İstanbul ΑΣ. x,,", None]
    texts += ["".join(chr(rnd.choice([rnd.randrange(128), rnd.randrange(0x3000), 32, 9])) for _ in range(60)) for _ in range(200)]
    name = tokens.default_tokenizer()
    alone = tokens.Encoder(name)
    for kind in (pa.string(), pa.large_string()):
        for some in (pa.array(texts, kind), pa.array(texts, kind).slice(3, 20), pa.array([], kind), pa.array([None, " "], kind)):
            got = [x.tobytes() for x in tokens.Encoder(name).encode_all(some)]
            assert got == [alone.encode(x) for x in some.to_pylist()]

    class Counting(tokens.Encoder):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    encode = Counting(name)
    assert len(list(encode.encode_all(pa.array(["one two two One"] * 50)))) == 50
    assert encode.asked <= (2 if together > 1000 else 100)


def test_terms_of_many_rests_have_no_postings():
    """Rows of the matrix and postings together score as all postings would, also after used rests are dropped."""
    rng = np.random.default_rng(7)
    rests = [np.concatenate([rng.integers(0, 30, 60), rng.integers(30, 3000, 20)]).astype("<u4") for _ in range(64)] + [np.array([2, 5000], "<u4")]
    idf, mean = rng.random(5001, np.float32) + 0.1, 80.0
    shard = packing.Shard(rests, idf, mean)
    assert len(shard.docs) and len(shard.dense) and not np.isin(shard.all_terms, shard.dense).any()
    held = {(int(d), int(t)) for d, t in zip(shard.docs, shard.all_terms)} | {(d, int(shard.dense[r])) for r, d in np.argwhere(shard.matrix)}
    assert held == {(d, int(t)) for d, x in enumerate(rests) for t in x}
    assert all(sum(t in x for x in rests) * packing.DENSE < len(rests) for t in set(shard.all_terms.tolist()))
    every = [dict(zip(*(x.tolist() for x in packing.impacts(r, idf, mean)))) for r in rests]
    for _ in range(2):
        for seed in (0, 9, 64):
            free = [i for i in range(65) if shard.left[i] and i != seed]
            score = {i: sum(every[i].get(t, 0.0) for t in every[seed]) for i in free}
            assert shard.neighbours(seed).tolist() == sorted(free, key=lambda i: -score[i])
        shard.left[10:50] = 0
        shard._drop_used()
        assert shard.matrix.shape[1] == 25
