import array
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import chat, common, compress, mixing, nearest, packing, pieces, rules, similar, simhash, token_files, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1: chat formatting


def test_escaping_is_reversible(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x<\\\\|", "\\<|", "<<||", "a<", "|>", "", None, "<\\", "plain", "\n\n"]
    rows = chat.render(spark.createDataFrame([(i, 0, "r\\n<|\n" + str(i), t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")).collect()
    for r in rows:
        body = r.rendered[len(chat.START) : -len(chat.STOP)]
        assert "<|" not in body
        role, _, rest = body.partition("\n")
        assert chat.unescape(rest) == (r.text or "") and chat.unescape_role(role) == r.role


def fold_by_hand(events):
    out = {}
    for conv, _, turn, kind, role, text in sorted(events, key=lambda e: (e[1], e[3] or "", e[4] or "", e[5] or "")):
        said = out.setdefault((conv, turn), ["", ""])
        said[0] = role or said[0]
        said[1] = {"edit": text or "", "regenerate": ""}.get(kind, said[1] + (text or ""))
    return {k: tuple(v) for k, v in out.items()}


def test_fold(spark):
    rnd = random.Random(4)
    events = [(rnd.randint(0, 2), i, rnd.randint(0, 2), rnd.choices(["delta", "edit", "regenerate", None, "other"], [8, 1, 1, 1, 1])[0], rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b ", None, "<|"])) for i in range(150)]
    events += [(9, 5, 0, "delta", "user", x) for x in ("b", "a", "a")]  # ties and repeated rows
    got = chat.fold(spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string"))
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in got.collect()} == fold_by_hand(events)


def test_a_streamed_log_folds_to_the_finished_one(spark, odd_rows):
    rows = [(d, i % 5, "user" if i % 2 else None, t) for i, (d, t, *_) in enumerate(odd_rows)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("seq", "kind", "_event", "rendered")})
    events = chat.conversations_as_events(df)
    streamed = chat.as_streamed(events)
    assert streamed.count() == 4 * len(rows) and streamed.where("kind <> 'delta'").count() == len(rows)
    key = lambda r: (str(r.conv_id), str(r.turn), r.role, r.text)
    got, want = (sorted(chat.fold(x).collect(), key=key) for x in (streamed, events))
    assert got == want and max(len(r.text) for r in got) > 100_000


def test_read_back(spark):
    import hashlib

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.conversations_as_events(df)))).collect()}
    for conv in (1, 2, None):
        said = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        learned = "".join(t for r, t in said if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(said) and r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert chat.read_back(chat.render(chat.fold(chat.conversations_as_events(df.limit(0))))).isEmpty()


# 2: packing


def test_packing(spark, odd, odd_rows, none):
    rows = packing.pack(odd, with_ids=True).collect()
    encode = tokens.encoder(tokens.default_tokenizer())
    ids = collections.Counter()
    for doc, text, *_ in odd_rows:
        ids[doc, encode.encode(text) + b"\2\0\0\0"] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for (doc, data), n in ids.items():
        want = np.frombuffer(data, "<u4")
        pieces_ = sorted(by_doc[doc], key=lambda r: r.start)
        if n == 1:
            assert [x for r in pieces_ for x in r.ids] == want.tolist() and {r.doc_tokens for r in pieces_} == {len(want)}
        assert sum(r.length for r in pieces_) == n * len(want)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(none).isEmpty()


def test_a_window_takes_the_best_neighbours():
    idf = np.log1p(np.ones(50)).astype(np.float32)
    about = lambda t, n: np.full(n, t, np.uint32)
    shard = packing.Shard([about(1, 2000), about(2, 2000), about(1, 2000), about(2, 2192)], idf, 2048.0)
    assert list(shard.windows()) == [[(0, 0, 2000), (2, 0, 2000), (1, 0, 96)], [(1, 96, 1904), (3, 0, 2192)]]


# 3: token counts


def greedy(word, first, inner):
    n = at = 0
    while at < len(word):
        known = inner if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_against_greedy_matching():
    rnd = random.Random(3)
    some = lambda: {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
    for _ in range(200):
        first, inner = some(), some()
        for other in (None, inner):
            automaton = pieces.Automaton(first, other)
            for _ in range(40):
                word = bytes(rnd.choices(b"abc", k=rnd.randint(0, 14)))
                assert automaton.count(word) == greedy(word, first, first if other is None else other)


def test_piece_counts(spark, odd, odd_rows, none):
    known = pieces.vocabulary(tokens.default_tokenizer())
    count = lambda t: sum(greedy(w, known, known) for w in (t or "").encode().lower().split())
    got = sorted((r.doc_id or 0, r.n_words, r.n_pieces) for r in pieces.count_pieces(odd).collect())
    assert got == sorted((d or 0, len(WORD.findall(t or "")), count(t)) for d, t, *_ in odd_rows)
    assert pieces.count_pieces(none).isEmpty()


# 4: mixing


def mix_by_hand(rows):
    size = [(d, s, len(WORD.findall(t or ""))) for d, t, _, s, _ in rows]
    total = collections.Counter()
    for _, s, n in size:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(total.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (goal - sum(2 * total[s] for s in full)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not more:
            return {s: (total[s], 2 * total[s] if s in full else level * weight[s]) for s in names}
        full |= more


def test_mix(spark, odd, odd_rows, none):
    got, want = mixing.mix(odd).collect(), mix_by_hand(odd_rows)
    assert len(got) == len(odd_rows)
    taken = collections.Counter()
    for r in got:
        assert (r.source_size, r.target) == (want[r.source][0], pytest.approx(want[r.source][1])) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    largest = collections.Counter()
    for _, t, _, s, _ in odd_rows:
        largest[s] = max(largest[s], len(WORD.findall(t or "")))
    assert all(abs(taken[s] - want[s][1]) <= largest[s] + 1 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(odd).collect()), key=str)
    assert mixing.mix(none).isEmpty() and set(mixing.repeated(odd, mixing.mix(odd)).columns) == set(odd.columns)


# 5: token files


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 15, 16, 17, 24, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5001).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == (5001 * bits + 7) // 8 and (token_files.unpack(data, 5001, bits) == ids).all()


def test_random_access(tmp_path):
    import pyarrow as pa

    for bits in (13, 16):
        ids = np.random.default_rng(1).integers(0, 1 << bits, 20_000).astype("<u4")
        out = token_files.Writer(open(tmp_path / f"{bits}.ids", "wb"), bits)
        for doc, (a, b) in enumerate([(0, 3), (3, 3), (3, 15_000), (15_000, 20_000)]):
            out.add(None if doc == 1 else doc, ids[a:b])
        out.close()
        reader = token_files.Reader(pa.OSFile(str(tmp_path / f"{bits}.ids")))
        assert (reader.ids(4095, 8193) == ids[4095:8193]).all() and [(d, s, len(x)) for d, s, x in reader.documents()] == [(0, 0, 3), (None, 3, 0), (2, 3, 14_997), (3, 15_000, 5000)]


def test_token_files(spark, odd, odd_rows, none):
    encode = tokens.encoder(tokens.default_tokenizer())
    want, at = [], 0
    for doc, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.frombuffer(encode.encode(text) + b"\2\0\0\0", "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_files.read_files(token_files.write_files(odd)).collect()), key=lambda r: r[1]) == want
    assert token_files.read_files(token_files.write_files(none)).isEmpty()


def test_ids_are_the_librarys():
    encode = tokens.encoder(tokens.default_tokenizer())
    for text in [
        "Don't STOP!!", "a<|endoftext|>b <|ENDOFTEXT|> x", "İ, ΑΣ. é, x́. ́a", "ab'll.' can't,; 12,3 ½x.", "A b c,. 　d ﬁ. ǅ,", "naïve,… “q” a|> <|start of",
        "".join(map(chr, range(33, 0x300))), " ".join(map(chr, range(33, 0x2500))), " ".join(f"a{chr(i)}" for i in range(33, 0x500)), "ÉCOLE Ñandú straße ŉ ǅ İI ſ ĸ",
        "\x1fa\x1c,b\x85c", "<|startoftext|>, HELLO", "WORD" * 40 + ".", "",
    ]:
        assert encode.encode(text) == array.array("I", encode.library.encode(text, add_special_tokens=False).ids).tobytes()


# 6 and 8: compression


@pytest.fixture(scope="module")
def two_languages(spark):
    """Texts of two vocabularies with the same letters; one in five without a language."""
    rnd = random.Random(7)
    words = {x: ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(80)] for x in ("en", "de")}
    rows = []
    for i in range(600):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rnd.choices(words[lang], k=rnd.randint(8, 120))), None if i % 5 == 0 else lang, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, spoken string")


def test_languages(two_languages):
    models = compress.learn_languages(two_languages)
    assert [n for n, _ in models] == ["en", "de"]
    rows = compress.identify(two_languages, models).join(two_languages.select("doc_id", "spoken"), "doc_id").collect()
    assert sum(r.lang_pred == r.spoken for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(odd, none):
    models = compress.learn_languages(odd)
    assert [n for n, _ in models][0] == "en" and {n for n, _ in models} == {"en", "de", "fr"}
    und = {r.doc_id: r.lang_pred for r in compress.identify(odd, models).collect()}
    assert [und[i] for i in (1, 2, 3, 8)] == ["und"] * 4 and und[9] != "und"
    assert compress.identify(none, compress.learn_languages(none)).isEmpty()
    assert {r.lang_pred for r in compress.identify(odd, []).collect()} == {"und"}


def test_held_out_rows_are_not_learned_from(spark, odd_rows):
    out = {d for d, *_ in odd_rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    df = spark.createDataFrame([(d,) for d, *_ in odd_rows], "doc_id long")
    assert {r.doc_id for r in df.where(compress.held_out()).collect()} == out
    assert {r.doc_id for r in df.where(compress.in_training()).collect()} == {d for d, *_ in odd_rows if d is not None} - out


def test_quality(spark, two_languages):
    labels = two_languages.select("doc_id", F.when(F.col("spoken") == "en", 1).otherwise(0).alias("quality"))
    rows = compress.scored(two_languages, compress.learn_quality(two_languages, labels)).select("row.doc_id", "score").join(labels, "doc_id").where(compress.held_out()).collect()
    assert len(rows) > 90 and np.mean([(r.score >= 0.5) == r.quality for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(40)] + [(100, 1, 0), (None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = compress.scored(odd, compress.learn_quality(odd, some)).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert compress.scored(none, compress.learn_quality(odd, labels)).isEmpty() and compress.scored(none, compress.learn_quality(none, labels)).isEmpty()


def plain_size(content, data, block):
    import zstandard

    extra = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
    made = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, write_dict_id=False, **extra)
    return sum(len(made.compress(data[i : i + block])) - 3 for i in range(0, len(data), block))


def test_predictions_by_plain_zstandard(spark, two_languages):
    """Languages and scores from the same dictionaries, with the library called plainly on every block."""
    models = compress.learn_languages(two_languages)
    got = {r.doc_id: r for r in compress.identify(two_languages, models).collect()}
    labels = two_languages.select("doc_id", F.when(F.col("spoken") == "en", 1).otherwise(0).alias("quality"))
    model = compress.learn_quality(two_languages, labels)
    scores = {r.row.doc_id: r.score for r in compress.scored(two_languages, model).collect()}
    for doc, text, *_ in two_languages.limit(40).collect():
        sizes = [plain_size(c, text.lower().encode(), 512) for _, c in models]
        assert got[doc].lang_pred == models[int(np.argmin(sizes))][0]
        assert got[doc].score == pytest.approx(1 / sum(math.exp(-compress.SHARPNESS * (x / min(sizes) - 1)) for x in sizes))
        x = []
        for view, (bad, good) in zip((text.encode(), compress.form(text.encode())), model["contents"]):
            b, g = plain_size(bad, view, 128), plain_size(good, view, 128)
            x.append((b - g) / (b + g))
        z = model["weights"][0] + model["weights"][1] * sum(math.tanh(8 * v) for v in x)
        assert scores[doc] == pytest.approx(1 / (1 + math.exp(-z)))


def test_many_languages(spark):
    rows = [(i, f"word{i % 300} und{i % 300} " * 30, f"l{i % 300:03d}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = compress.learn_languages(docs)
    assert len(models) == 300
    found = compress.identify(docs.limit(100), models).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 100 and sum(r.lang == r.lang_pred for r in found) >= 90


def test_samples_are_limited_by_rows(spark):
    """However often a row or an id is repeated; all places of a long text can be chosen."""
    rows = spark.range(50_000).select(F.lit("a").alias("_class"), F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    def drawn(rows):
        slim = compress.slim_rows(rows.select("_class", "doc_id", compress.place().alias("_place")))
        return compress.sampled(rows, slim, compress.class_counts(slim, 10), 100)

    assert drawn(rows).count() == 100
    long = spark.createDataFrame([("a", 1, "".join(f"{i:08d}" for i in range(32 * 3000)))], "_class string, doc_id long, text string")
    blocks = compress.snippets(drawn(long), 64)["a"]
    assert len(blocks) == 64 and len(set(blocks)) == 64 and max(int(b[:8]) for b in blocks) > 48_000 > min(int(b[:8]) for b in blocks)


def test_form():
    assert compress.form("Ab, cÉ 12!\n Ab Ab Ab\tAb x".encode()) == b"Aa, aaa 00!\n Aa" + bytes([129, 130, 131]) + b" a"
    assert compress.form(b"") == b"" and compress.form(b"a " * 200)[:-1] == b"a" + bytes(128 + i % 128 for i in range(1, 200))


def test_the_difference_of_words_carries_weight(spark, two_languages):
    """Good and bad texts of one form: only their words tell them. Few labelled rows, too."""
    labels = two_languages.select("doc_id", F.when(F.col("spoken") == "en", 1).otherwise(0).alias("quality"))
    for some in (labels, labels.where("doc_id % 6 = 0 or doc_id % 12 = 1")):
        model = compress.learn_quality(two_languages, some)
        rows = compress.measured(two_languages, [model["contents"]], ["doc_id"]).select("row.doc_id", "difference").join(labels, "doc_id").collect()
        words = {k: np.mean([r.difference[0] for r in rows if r.quality == k]) for k in (0, 1)}
        assert model["weights"][1] > 0 and words[0] < -0.1 < 0.1 < words[1]


def test_what_cannot_be_told_apart_has_the_share_of_labels(spark):
    """Labels against what the sampled rows show, and one row of each label."""
    docs = spark.createDataFrame([(i, f"same words in all of them {i // 2}") for i in range(40)] + [(100, "x"), (101, "y")], "doc_id long, text string")
    for ids in (range(40), (100, 101)):
        labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
        scores = [r.score for r in compress.scored(docs, compress.learn_quality(docs, labels)).collect()]
        assert len(scores) == 42 and all(0 <= x <= 1 for x in scores)
    assert compress.fit(np.array([0.5, -0.5, 0.6, -0.4]), np.array([0.0, 1, 0, 1]))[1] < 0


# 7: SimHash


def print_by_hand(text, k=3):
    import xxhash

    words = [w.encode() for w in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_hand(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def test_simhash(spark, odd, odd_rows, none):
    want = [(d, print_by_hand(t)) for d, t, *_ in odd_rows]
    root = components_by_hand({p for _, p in want}, 2)
    least = {}
    for d, p in want:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    got = sorted(((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.deduplicated(odd).select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id").collect()))
    assert got == sorted((d or 0, f"{p:016x}", least[root[p]]) for d, p in want)
    assert simhash.deduplicated(none).isEmpty()


def test_links_of_close_fingerprints(spark):
    rnd = random.Random(8)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        p = rnd.getrandbits(64)
        for _ in range(6):  # chains of small steps
            prints.add(p)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                p ^= 1 << b
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    for radius in (2, 4):
        roots = common.components(simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), radius))
        got = {r.node: r.root for r in roots.collect()}
        want = components_by_hand(prints, radius)
        same = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        assert same({signed(p): got.get(signed(p), signed(p)) for p in prints}) == same({signed(p): signed(r) for p, r in want.items()})
    with pytest.raises(ValueError):
        simhash.masks(3)


def test_spread_join(spark):
    """A hot key's rows are dealt to parts and each is joined once."""
    rows = common.written(spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("key")))
    others = spark.createDataFrame([(7, "hot"), (3, "cold"), (-1, "none")], "key long, name string")
    want = sorted([(i, "hot") for i in range(0, 5000, 2)] + [(7, "hot"), (3, "cold")])
    for by in ((), ("id",)):
        assert sorted((r.id, r.name) for r in common.spread_join(rows, others, "key", by).collect()) == want
        left = common.spread_join(rows, others, "key", by, how="left")
        assert left.count() == 5000 and left.where("name is not null").count() == len(want)
    assert common.spread_join(rows.limit(0), others, "key").isEmpty()


def test_components_of_a_hub(spark):
    edges = [(-1, i) for i in range(3000)] + [(i, 10_000 + i) for i in range(3000)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 6001 and set(got.values()) == {-1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_similar_texts_are_grouped(spark):
    rnd = random.Random(2)
    from .conftest import prose

    base = prose(rnd, 200).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:100] + ["changed"] + base[101:])), (3, " ".join(base + ["and", "more"])), (4, prose(rnd, 200)), (5, None), (6, ""), (7, " ".join(base[:100] + prose(rnd, 100).split()))]
    got = {r.doc_id: r.group_id for r in similar.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_grouping_odd_rows(spark, odd, none):
    got = collections.defaultdict(set)
    for r in similar.grouped(odd).collect():
        got[r.doc_id].add(r.group_id)
    assert got[5] == got[4] == got[None] == {4} and got[2] == got[3] == {1} and got[100] == {100}
    assert similar.grouped(none).isEmpty()


# 9: nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[500:900] = x[300]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[100].tolist()), (5000, None), (5100, [0.0] * 16), (5200, [float("nan")] + [1.0] * 15), (5300, [None] + [1.0] * 15), (5400, [1.0, 2.0]), (5500, []), (None, x[1].tolist())]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = set()
    for q in range(0, 3000, 100):
        away = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), away)) if i != q][:10]
        want |= {(q, k + 1, int(i), round(float(away[i]), 9)) for k, i in enumerate(order)}
    found = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()}
    assert len(found & want) >= 0.97 * len(want) and len(found) == len(want)
    clash = spark.createDataFrame(rows[:300], "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("dim", "cid", "ids", "limit", "rank", "_bad")})
    assert nearest.search(clash).count() == 30
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.search(few).collect()] == [(0, 1, 1)]
    assert nearest.search(few.limit(0)).isEmpty()


# 10: quality rules


def measures_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd, odd_rows, none):
    rnd = random.Random(9)
    more = [" ".join(rnd.choices("ab", k=rnd.randint(0, 60))) for _ in range(30)] + ["a\n\na\n a\na", "x " * 300, "\n", "one", "#*$ %&|<>"]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(more)], "doc_id long, text string, lang string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[c] for c in names) for r in rules.measures(rows).collect()} == {i: measures_by_hand(t) for i, t in enumerate(more)}
    got = sorted(tuple(r[c] for c in names) for r in rules.measures(odd).collect())
    assert got == sorted(measures_by_hand(t) for _, t, *_ in odd_rows)
    assert rules.measures(none).isEmpty()


def test_binomial_tail(spark):
    rows = [(0, 500), (3, 1000), (8, 1000), (700, 100_000), (0, 1), (900, 100_000), (99_000, 10_000_000), (99_900, 10_000_000)]
    df = spark.createDataFrame(rows, "k long, n long")
    for r in df.select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        log = lambda i: math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)  # noqa: B023, E731
        assert r.p == pytest.approx(math.fsum(math.exp(log(i)) for i in range(r.k + 1)), rel=1e-6)


def test_thresholds_hold_the_risk(spark):
    shout = "ABC DEF GHI JKL MNO PQR STU " * 4
    calm = "abc def ghi jkl mno pqr stu xyz " * 4
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        stratum = "en" if i < 1000 else "small"
        rows.append((i, (shout if bad else calm) + f" w{i}", stratum))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("size", F.lit(1))
    out = {r.doc_id: r for r in rules.judged(docs.withColumn("text", F.concat("text", F.lit(" some words that no window of this text has twice"))), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    big = [out[i] for i in range(1000)]
    assert all("shouting" in r.rejected_by if r.doc_id % 4 == 0 else not r.rejected_by for r in big)
    assert not any(out[i].rejected_by for i in range(1000, 1200))  # too few labels to be sure
    # copies of one text are one text, however often it was labelled
    copies = docs.where("doc_id < 200").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(calm)).crossJoin(spark.range(20).select("id"))
    copies = copies.withColumn("doc_id", F.col("doc_id") + 10_000 * F.col("id"))
    marks = copies.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    assert all(not r.rejected_by for r in rules.judged(copies.drop("id"), marks).collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(not r.rejected_by for r in rules.judged(docs, none).collect())


def test_rules_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(100, 1, 0), (100, 0, 0), (None, 1, 0), (101, None, 0), (102, 7, 0)], "doc_id long, quality int, toxic int")
    rows = rules.judged(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.kept == (not r.base_failed) for r in rows)
    assert rules.judged(none, labels).isEmpty()
