"""Text to normalized text, lexemes and the text that is embedded."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmer import stem

# The words that are left out of lexemes, and what punctuation leaves of contractions.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing would should could ought
a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very
can will just don now
s t m d ll re ve ain aren couldn didn doesn hadn hasn haven isn mustn needn shan shouldn wasn weren won wouldn
""".split()

#: Texts of these characters alone are the same in NFKC, and their lower case is Java's: no Python is needed.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
_PLAIN_SPACE = r"[\t\n\x0B\f\r ]+"
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
#: Words whose stem a worker keeps.
_MOST_STEMS = 1 << 18
_stems: dict[str, str] = {}


def normalize_text(text: str) -> str:
    """NFKC, lower case code point by code point, white space to single spaces."""
    folded = unicodedata.normalize("NFKC", text).replace("Σ", "σ").replace("İ", "i").lower()
    return _SPACE.sub(" ", folded).strip(" ")


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


def normalize(text: Column) -> Column:
    """Plain texts stay in the JVM; the others go through Python, where NFKC is."""
    plain = text.rlike(PLAIN)
    native = F.trim(F.regexp_replace(F.lower(text), _PLAIN_SPACE, " "))
    return F.when(plain, native).otherwise(F.pandas_udf(_normalized, "string")(F.when(~plain, text)))


def stemmed_words(words: list[str]) -> list[str]:
    out = []
    for w in words:
        s = _stems.get(w)
        if s is None:
            s = stem(w)
            if len(_stems) < _MOST_STEMS:
                _stems[w] = s
        out.append(s)
    return out


def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda row: [s for s in stemmed_words(row) if s], na_action="ignore")


def words(normalized: Column) -> Column:
    """The runs of letters and digits, without stop words; repeated words stay, as their number counts."""
    parts = F.split(normalized, r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(STOPWORDS))


def lexemes(text: Column, stemmed: bool = True) -> Column:
    """Words of the normalized text, stemmed unless told otherwise; none for null."""
    found = words(normalize(F.coalesce(text, F.lit(""))))
    return F.pandas_udf(_stemmed, "array<string>")(found) if stemmed else found


def format_for_embedding(ts: Column, speaker: Column, text: Column) -> Column:
    """[date] speaker: text, without the parts that are missing."""
    return F.concat(
        F.when(ts.isNotNull(), F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd"), F.lit("] "))).otherwise(""),
        F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise(""),
        F.coalesce(text, F.lit("")),
    )
