import datetime as dt
import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import dates, keys, text, vectors
from lorekeep.functions.stemmer import stem


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    given = ["ﬁsh  ﬂight", "Ｈｅｌｌｏ　World", "a b\t c", "x²", "  ", None, "ÀÉ\nÖ", "ΟΔΟΣ", " x y "]
    assert column(spark, given, text.normalize) == ["fish flight", "hello world", "a b c", "x2", "", None, "àé ö", "οδοσ", "x y"]


def test_lexemes(spark):
    given = ["The quick brown foxes were running", "Hello, WORLD! really", "I don't think it works", "Paris trip in May 2023", "RUNNING runner run", "the of and", "", None]
    assert column(spark, given, text.lexemes) == [
        ["quick", "brown", "fox", "run"], ["hello", "world", "realli"], ["think", "work"], ["pari", "trip", "may", "2023"], ["run", "runner", "run"], [], [], [],
    ]


def test_stopwords_are_complete():
    assert len(text.STOPWORDS) == len(set(text.STOPWORDS)) == 152


@pytest.mark.parametrize(
    "word, expected",
    [
        ("generously", "generous"), ("consistently", "consist"), ("happiness", "happi"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"),
        ("agreed", "agre"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("this", "this"), ("dying", "die"), ("succeeding", "succeed"), ("by", "by"), ("say", "say"),
        ("cry", "cri"), ("adoption", "adopt"), ("controlled", "control"), ("conspicuous", "conspicu"), ("electricity", "electr"), ("communism", "communism"), ("youth", "youth"),
        ("knees", "knee"), ("caresses", "caress"), ("gaps", "gap"), ("kiwis", "kiwi"), ("luxuriated", "luxuri"), ("skis", "ski"), ("news", "news"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_parse_timestamp(spark):
    given = [
        "1:56 pm on 8 May, 2023", "1:56 PM on 8 May 2023", "13:56 on 8 May, 2023", "8 May, 2023", "2023/05/20 (Sat) 02:21", "2023-05-02 10:15", "2023-06-10",
        "2023-05-02T10:15:00+03:00", " 12:05 AM on 1 January 2024 ", "03/04/2023", "", "garbage", "2023", "32 May, 2023", None,
    ]
    at = lambda *x: dt.datetime(*x)
    assert column(spark, given, dates.parse_timestamp) == [
        at(2023, 5, 8, 13, 56), at(2023, 5, 8, 13, 56), at(2023, 5, 8, 13, 56), at(2023, 5, 8), at(2023, 5, 20, 2, 21), at(2023, 5, 2, 10, 15), at(2023, 6, 10),
        at(2023, 5, 2, 7, 15), at(2024, 1, 1, 0, 5), None, None, None, None, None, None,
    ]


@pytest.mark.parametrize(
    "said, expected",
    [
        ("what did she do last Tuesday?", (2023, 5, 9)), ("yesterday", (2023, 5, 11)), ("two weeks ago", (2023, 4, 28)), ("next monday", (2023, 5, 15)),
        ("a month ago", (2023, 4, 12)), ("in 3 days", (2023, 5, 15)), ("last year", (2022, 5, 12)), ("this friday", (2023, 5, 12)), ("nothing here", None), ("999999 years ago", None),
    ],
)
def test_relative(spark, said, expected):
    base = F.lit("2023-05-12").cast("timestamp")
    assert column(spark, [said], lambda s: dates.parse_relative(s, base)) == [expected and dt.datetime(*expected)]


def relative_by_hand(text, base):
    """The first expression in the text, by plain Python."""
    import calendar

    number = dict(zip("one two three four five six seven eight nine ten eleven twelve a an".split(), [*range(1, 13), 1, 1])) | {"a few": 3, "a couple of": 2}
    count, unit = r"(\d+|a couple of|a few|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)", r"(second|minute|hour|day|week|month|year)s?"
    days = "monday tuesday wednesday thursday friday saturday sunday".split()
    day = "(" + "|".join([*days, *(d[:3] for d in days), "tue", "tues", "thurs"]) + ")"
    rules = [r"(yesterday|today|tonight|tomorrow|last night)", rf"(last|past|next|this)\s+{day}", rf"{count}\s+{unit}\s+ago", rf"(?:in|within)\s+{count}\s+{unit}", r"(last|past|next)\s+(week|month|year)"]
    found = [(m.start(), i, [g.lower() for g in m.groups()]) for i, r in enumerate(rules) if (m := re.search(rf"\b(?:{r})\b", text, re.I))]
    if not found:
        return None
    _, rule, g = min(found)

    def moved(n, unit):
        if unit in ("month", "year"):
            at = base.year * 12 + base.month - 1 + n * (12 if unit == "year" else 1)
            if not 12 <= at < 120_000:
                return None
            last = calendar.monthrange(at // 12, at % 12 + 1)[1]
            return base.replace(year=at // 12, month=at % 12 + 1, day=min(base.day, last))
        try:
            return base + dt.timedelta(**{f"{unit}s": n})
        except OverflowError:
            return None

    if rule == 0:
        return moved({"yesterday": -1, "last night": -1, "tomorrow": 1}.get(g[0], 0), "day")
    if rule == 1:
        away = (next(i for i, d in enumerate(days) if d[:3] == g[1][:3]) - base.weekday()) % 7
        return moved(away - 7 if g[0] in ("last", "past") else away or 7 if g[0] == "next" else away, "day")
    if rule == 4:
        return moved(1 if g[0] == "next" else -1, g[1])
    n = number[g[0]] if g[0] in number else int(g[0])
    return moved(-n if rule == 2 else n, g[1])


def test_relative_dates_by_hand(spark):
    """All rules, their words and bounds, several in a text, and no Python in the plan."""
    rnd = random.Random(6)
    counts = ["a", "an", "a few", "a couple of", "one", "Twelve", "3", "40", "0", "99999", "123456789012", "99999999999999999999999"]
    units, days = ["second", "minutes", "hour", "days", "week", "MONTHS", "years"], ["Monday", "tue", "Tues", "wed", "thursday", "thurs", "fri", "saturday", "Sun"]

    def phrase():
        return [
            lambda: rnd.choice(["yesterday", "Today", "tonight", "tomorrow", "last night"]), lambda: f"{rnd.choice(['last', 'past', 'Next', 'this'])} {rnd.choice(days)}",
            lambda: f"{rnd.choice(counts)} {rnd.choice(units)}  ago", lambda: f"{rnd.choice(['in', 'within'])} {rnd.choice(counts)} {rnd.choice(units)}",
            lambda: f"{rnd.choice(['last', 'next', 'past'])} {rnd.choice(['week', 'month', 'year'])}", lambda: "what about Paris", lambda: "ago in last", lambda: "lastmonday",
        ][rnd.randrange(8)]()

    rows = [(" ".join(phrase() for _ in range(rnd.randint(1, 3))), dt.datetime(2023, rnd.randint(1, 12), rnd.randint(1, 28), 7, 30) + dt.timedelta(days=rnd.randint(0, 3))) for _ in range(700)]
    rows += [(None, rows[0][1]), ("yesterday", None), ("", rows[0][1]), ("a month ago", dt.datetime(2024, 3, 31)), ("in a year", dt.datetime(2024, 2, 29)), ("3000 years ago", dt.datetime(2024, 2, 29))]
    df = spark.createDataFrame(rows, "said string, base timestamp").withColumn("found", dates.parse_relative(F.col("said"), F.col("base")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = [(r, w) for r in df.collect() if r.found != (w := r.said and r.base and relative_by_hand(r.said, r.base) or None)]
    assert not wrong, wrong[:5]


def test_query_time_prefers_a_whole_date_and_needs_a_base(spark):
    base = F.when(F.col("s") != "tomorrow", F.lit("2023-05-12").cast("timestamp"))
    found = column(spark, ["2020-01-02", "yesterday", "tomorrow", "who?"], lambda s: dates.query_time(s, base))
    assert found == [dt.datetime(2020, 1, 2), dt.datetime(2023, 5, 11), None, None]


def test_format_for_embedding(spark):
    rows = spark.createDataFrame([("2023-05-30 23:00:00", "user", "hi"), (None, "bo", "hi"), (None, "", "bare"), (None, None, None)], "ts string, who string, t string")
    out = rows.select(text.format_for_embedding(F.col("ts").cast("timestamp"), F.col("who"), F.col("t")).alias("x"))
    assert [r.x for r in out.collect()] == ["[2023-05-30] user: hi", "bo: hi", "bare", ""]


def test_vectors(spark):
    given = [[3.0, 4.0], [0.0, 0.0], None]
    assert [v and [round(x, 6) for x in v] for v in column(spark, given, vectors.l2_normalize, "array<float>")] == [[0.6, 0.8], [0.0, 0.0], None]
    packed = column(spark, [[1.0] * 768, None], vectors.pack_vector, "array<float>")
    assert len(packed[0]) == 3072 and packed[0][:4] == bytes.fromhex("0000803f") and packed[1] is None
    assert np.allclose(column(spark, packed, vectors.unpack_vector, "binary")[0], 1)
    with pytest.raises(Exception, match="no vector"):
        column(spark, [b"12345"], vectors.unpack_vector, "binary")
    assert column(spark, given[:2], lambda v: vectors.cosine(v, F.array(F.lit(3.0), F.lit(4.0))), "array<float>") == [1.0, 0.0]


def test_keys(spark):
    import hashlib

    names = ["conv-26", "0", "x9"]
    want = [max(1, int.from_bytes(hashlib.sha256(f"locomo/{n}".encode()).digest()[:8], "big") & (2**63 - 1)) for n in names]
    assert column(spark, names, lambda s: keys.surrogate_id(F.lit("locomo"), s)) == want
    assert [len(x.encode()) for x in column(spark, ["é" * 700, "ab", "a" + "é" * 700], keys.truncate_utf8)] == [1200, 2, 1199]
    body = column(spark, ["a<b & c"], lambda s: keys.envelope(conversation_id=F.lit("1"), session_id=F.lit("s"), turn_id=F.lit(None), text=s, speaker=F.lit("")))[0]
    assert body == '{"conversation_id":"1","session_id":"s","turn_id":"","text":"a\\u003cb \\u0026 c"}'
    assert column(spark, [body], lambda s: keys.parse_envelope(s)["text"]) == ["a<b & c"]
    document, query = (column(spark, ["t"], lambda s, p=p: keys.cache_key(F.lit(p), s))[0] for p in ("search_document: ", "search_query: "))
    assert document == hashlib.sha256(b"search_document: t").digest() != query
