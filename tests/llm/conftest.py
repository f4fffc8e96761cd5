import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n, letters="abcdefghij"):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows and ties."""
    rnd = random.Random(11)
    copy = prose(rnd, 60)
    rows = [
        (1, None, "en", "src1", None), (2, "", None, None, 0), (3, " \n\t ", "en", "src1", 3), (4, copy, "en", "src1", 1), (5, copy, "de", None, 1),
        (5, copy, "de", None, 1), (6, prose(rnd, 30_000), "en", "src2", 1), (7, "word", "fr", "src2", 4), (None, copy, None, "src9", 1), (8, "1234 ###", "en", "src2", 8),
        (9, "é" * 5000 + " İstanbul ΑΣ <|endoftext|> 'll.", "de", "src1", 1),
    ]
    rows += [(100 + i, prose(rnd, rnd.randint(5, 200), "abcdefghij" if i % 2 else "klmnopqrst"), "en" if i % 2 else "de", f"src{i % 3}", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With further columns whose names the operators use inside."""
    rows = spark.createDataFrame(odd_rows, KIND)
    from pyspark.sql import functions as F

    names = ("size", "rank", "fp", "component_id", "copies", "score", "stratum", "_words", "n", "ids", "key", "target", "kept", "weight", "_class")
    return rows.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)
