"""Absolute and relative dates. Absolute ones are matched by a whitelist of shapes, so that nothing ambiguous is guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_IN_BRACKETS = r"\(\s*(\p{L}+)\s*\)"
_MONTH = r"(?:jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|september|oct|october|nov|november|dec|december)"
_LONG = rf"{_MONTH},? \d{{4}}$"

# The shapes that are accepted, each with the pattern that reads it.
SHAPES = (
    (rf"^\d{{1,2}}:\d{{2}} [ap]m on \d{{1,2}} {_LONG}", "h:mm a 'on' d MMMM yyyy"),
    (rf"^\d{{1,2}}:\d{{2}} on \d{{1,2}} {_LONG}", "H:mm 'on' d MMMM yyyy"),
    (rf"^\d{{1,2}} {_LONG}", "d MMMM yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "yyyy/M/d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
)
_ISO = r"^\d{4}-\d{2}-\d{2}[tT ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[zZ]|[+-]\d{2}:?\d{2})?$"


def parse_timestamp(text: Column) -> Column:
    """A timestamp in the session's zone, UTC here; null if the text is no date of an accepted shape."""
    # a word in brackets is dropped if it is the name of a day, or begins as one does
    word = F.lower(F.regexp_extract(text, _IN_BRACKETS, 1))
    named = F.substring(word, 1, 3).isin([d[:3] for d in _DAYS])
    bare = F.trim(F.regexp_replace(F.when(named, F.regexp_replace(text, _IN_BRACKETS, " ")).otherwise(text), r"\s+", " "))
    # month names are read with a capital first letter, and either of am and AM
    said = F.regexp_replace(bare, r"(?<=[A-Za-z]),", "")
    titled = F.regexp_replace(F.initcap(said), r"\bOn\b", "on")
    titled = F.regexp_replace(F.regexp_replace(titled, r"(?<=\d )Am\b", "AM"), r"(?<=\d )Pm\b", "PM")
    short = F.length(F.regexp_extract(titled, r"([A-Z][a-z]+) \d{4}$", 1)) == 3
    tries = []
    for shape, pattern in SHAPES:
        fits = F.lower(said).rlike(shape)
        if "MMMM" in pattern:
            tries.append(F.when(fits & short, F.try_to_timestamp(titled, F.lit(pattern.replace("MMMM", "MMM")))))
        tries.append(F.when(fits, F.try_to_timestamp(titled, F.lit(pattern))))
    tries.append(F.when(bare.rlike(_ISO), F.try_to_timestamp(F.upper(bare))))
    return F.coalesce(*tries)


_DAY = r"(mon(?:day)?|tues?(?:day)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
_NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1, "a few": 3, "a couple of": 2}
_COUNT = r"([0-9]+|a couple of|a few|an?|" + "|".join(list(_NUMBERS)[1:13]) + ")"
_UNIT = r"(second|minute|hour|day|week|month|year)s?"
#: Of the units that have one length, their seconds; of the others, their months.
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
_MONTHS = {"month": 1, "year": 12}
#: What is further away than this isn't looked for.
_MOST_SECONDS, _MOST_MONTHS = 4e11, 120_000


def _moved(base: Column, n: Column, unit: Column) -> Column:
    """The base and n units; null beyond the years 1 to 9999. Months end with their last day."""
    length, months = (F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), unit) for table in (_SECONDS, _MONTHS))
    near = F.abs(n.cast("double") * F.coalesce(length / _MOST_SECONDS, months / _MOST_MONTHS)) <= 1
    by_length = F.timestamp_micros(F.unix_micros(base) + F.when(near, n).cast("bigint") * length * 1_000_000)
    by_months = base + F.make_ym_interval(F.lit(0), (F.when(near, n) * months).cast("int"))
    out = F.when(length.isNotNull(), by_length).otherwise(by_months)
    return F.when(F.year(out).between(1, 9999), out)


def _to_day(base: Column, which: Column, name: Column) -> Column:
    days = F.array(*(F.lit(d[:3]) for d in _DAYS))
    away = F.pmod(F.array_position(days, F.substring(name, 1, 3)) - 1 - F.weekday(base), F.lit(7))
    away = F.when(which.isin("last", "past"), away - 7).when((which == "next") & (away == 0), 7).otherwise(away)
    return _moved(base, away, F.lit("day"))


def _number(said: Column) -> Column:
    words = F.create_map(*(F.lit(x) for kv in _NUMBERS.items() for x in kv))
    return F.coalesce(F.try_element_at(words, said).cast("bigint"), said.try_cast("bigint"))


def _rule(pattern: str) -> str:
    """As a whole word, in any case of ASCII letters."""
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


#: A pattern, and the time that its groups (lower-cased) tell from a base. Of several that are found the first in the text counts.
RULES = (
    (_rule("(yesterday|today|tonight|tomorrow|last night)"), lambda base, g: _moved(base, F.when(g(1).isin("yesterday", "last night"), -1).when(g(1) == "tomorrow", 1).otherwise(0), F.lit("day"))),
    (_rule(rf"(last|past|next|this)\s+{_DAY}"), lambda base, g: _to_day(base, g(1), g(2))),
    (_rule(rf"{_COUNT}\s+{_UNIT}\s+ago"), lambda base, g: _moved(base, -_number(g(1)), g(2))),
    (_rule(rf"(?:in|within)\s+{_COUNT}\s+{_UNIT}"), lambda base, g: _moved(base, _number(g(1)), g(2))),
    (_rule(r"(last|past|next)\s+(week|month|year)"), lambda base, g: _moved(base, F.when(g(1) == "next", 1).otherwise(-1), g(2))),
)


def parse_relative(text: Column, base: Column) -> Column:
    """The first relative date in the text, from the base; null without either, or if it's out of range. A table of rules as
    one expression, which stays in the JVM."""
    places = [F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0)) for pattern, _ in RULES]
    first, out = F.least(*places), F.lit(None).cast("timestamp")
    for place, (pattern, told) in reversed(list(zip(places, RULES))):
        out = F.when(place == first, told(base, lambda i, p=pattern: F.lower(F.regexp_extract(text, p, i)))).otherwise(out)
    return out


def query_time(question: Column, base: Column) -> Column:
    """The whole question as a date, or else a relative date in it, from the base; null if there is neither."""
    return F.coalesce(parse_timestamp(question), parse_relative(question, base))
