"""Fixtures, LoCoMo and LongMemEval documents as turns and questions.

turns: conversation_id, session_id, turn_id, speaker, text, date_time, pos. questions: query_id, conversation_id, question,
question_date, evidence, grp. Each reader parses JSON with a declared schema. Arrays of
documents are read in byte ranges; a file of fixtures is one object, and read whole."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.keys import surrogate_id, turn_id
from lorekeep.sources.json_arrays import read_array


class Dataset(NamedTuple):
    turns: DataFrame
    questions: DataFrame


#: Where each dataset's file may be, under the folder that DATASETS_DIR names.
FILES = {
    "fixtures": ("fixtures.json",),
    "locomo": ("locomo10.json", "locomo/locomo10.json"),
    "longmemeval_s": ("longmemeval_s.json", "longmemeval_s_cleaned.json", "longmemeval/longmemeval_s.json"),
}

FIXTURES = (
    "turns array<struct<id string, session_id string, speaker string, text string, date_time string>>, "
    "questions array<struct<id string, question string, evidence array<string>, question_date string>>"
)
LOCOMO = "sample_id string, conversation map<string, string>, qa array<struct<question string, category int, evidence string>>"
LOCOMO_TURNS = "array<struct<speaker string, dia_id string, text string, blip_caption string>>"
LONGMEMEVAL = (
    "question_id string, question_type string, question string, question_date string, haystack_dates array<string>, "
    "haystack_session_ids array<string>, haystack_sessions array<array<struct<role string, content string, has_answer boolean>>>, "
    "answer_session_ids array<string>"
)
#: Questions whose id ends in this have no answer in their conversation.
ABSTAINS = "_abs"


def find_file(explicit: str | None, candidates: Iterable[str], folder: str | None = None) -> str:
    """The explicit path, or the first candidate that exists."""
    if explicit:
        return explicit
    folder = folder or os.environ.get("DATASETS_DIR", "datasets")
    tried = [os.path.join(folder, c) for c in candidates]
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"none of {', '.join(tried)} is there")


def _documents(spark: SparkSession, path: str, schema: str, array: bool) -> DataFrame:
    """The documents of a file, or of a folder's files; one that doesn't parse is an error. An array is read in byte ranges,
    one document a row; a file that is a single object is one row."""
    kind = f"struct<{_named(schema)}>"
    if array:
        return read_array(spark, path).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("doc")).select("doc.*")
    rows = spark.read.text(path, wholetext=True)
    right = F.startswith(F.ltrim("value", F.lit(" \t\r\n﻿")), F.lit("{"))
    checked = F.when(right, F.from_json("value", kind, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("the document is no object")))
    return rows.select(checked.alias("doc")).select("doc.*")


def _named(schema: str) -> str:
    """A table's schema as that of a struct."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in _struct(schema).fields)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """pos: a conversation's turns in order, from 0."""
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("conversation_id").orderBy(*order)) - 1).cast("int"))


_TURNS = ("conversation_id", "session_id", "turn_id", "speaker", "text", "date_time", "pos")


def fixtures(spark: SparkSession, path: str) -> Dataset:
    """One conversation, one group."""
    doc = _documents(spark, path, FIXTURES, False)
    conv = surrogate_id(F.lit("fixtures"), F.lit("fixtures")).cast("string").alias("conversation_id")
    turns = doc.select(F.posexplode("turns").alias("pos", "t")).select(conv, "t.session_id", F.col("t.id").alias("turn_id"), "t.speaker", "t.text", F.coalesce("t.date_time", F.lit("")).alias("date_time"), "pos")
    asked = doc.select(F.explode("questions").alias("q")).select(F.col("q.id").alias("query_id"), conv, "q.question", "q.question_date", "q.evidence", F.lit("fixtures").alias("grp"))
    return Dataset(turns.select(*_TURNS), asked)


def _flat(values: pd.Series) -> pd.Series:
    """JSON that is a string, null, or strings in arrays of any depth, as one list; anything else is an error."""

    def walk(x: object) -> list[str]:
        if x is None:
            return []
        if isinstance(x, str):
            return [x]
        if isinstance(x, list):
            return [s for part in x for s in walk(part)]
        raise ValueError(f"{x!r} is neither a string nor a list of strings")

    def parse(v: str | None) -> list[str]:
        if v is None or not v.strip():
            return []
        try:
            return walk(json.loads(v))
        except json.JSONDecodeError:
            return [v]  # a bare string, which from_json gives without its quotes

    return values.map(parse)


def flattened(value: Column) -> Column:
    return F.pandas_udf(_flat, "array<string>")(value)


def locomo(spark: SparkSession, path: str) -> Dataset:
    """Sessions are keys session_N of a document, in the order of N; their date is session_N_date_time."""
    doc = _documents(spark, path, LOCOMO, True).withColumn("conversation_id", surrogate_id(F.lit("locomo"), F.col("sample_id")).cast("string"))
    entries = doc.select("conversation_id", "conversation", F.explode(F.map_entries("conversation")).alias("e"))
    is_session = F.col("e.key").rlike(r"^session_\d+$")
    sessions = entries.where(is_session).select(
        "conversation_id",
        F.regexp_extract("e.key", r"(\d+)$", 1).cast("int").alias("n"),
        # guarded once more: a plan may parse before it filters
        F.from_json(F.when(is_session, F.col("e.value")), LOCOMO_TURNS, {"mode": "FAILFAST"}).alias("turns"),
        F.coalesce(F.try_element_at("conversation", F.concat("e.key", F.lit("_date_time"))), F.lit("")).alias("date_time"),
    )
    rows = sessions.select("conversation_id", "n", "date_time", F.posexplode("turns").alias("i", "t"))
    rows = rows.select("conversation_id", F.concat(F.lit("session_"), "n").alias("session_id"), F.col("t.dia_id").alias("turn_id"), "t.speaker", "t.text", "date_time", "n", "i")
    asked = doc.select("conversation_id", "sample_id", F.posexplode("qa").alias("i", "q")).select(
        F.concat("sample_id", F.lit("_q"), "i").alias("query_id"),
        "conversation_id",
        "q.question",
        F.lit(None).cast("string").alias("question_date"),
        flattened(F.col("q.evidence")).alias("evidence"),
        F.concat(F.lit("category_"), "q.category").alias("grp"),
    )
    return Dataset(_numbered(rows, "n", "i").select(*_TURNS), asked)


def longmemeval(spark: SparkSession, path: str) -> Dataset:
    """One conversation per question. Sessions beyond the ids are left out; a date that's missing is empty."""
    doc = _documents(spark, path, LONGMEMEVAL, True).withColumn("conversation_id", surrogate_id(F.lit("longmemeval_s"), F.col("question_id")).cast("string"))
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    sessions = doc.select("conversation_id", "question_id", F.posexplode(zipped).alias("n", "s")).where("s.haystack_session_ids is not null")
    said = sessions.select("conversation_id", "question_id", "n", F.col("s.haystack_session_ids").alias("session_id"), F.coalesce("s.haystack_dates", F.lit("")).alias("date_time"), F.posexplode("s.haystack_sessions").alias("i", "t"))
    rows = said.select("conversation_id", "question_id", "session_id", turn_id(F.col("session_id"), F.col("i")).alias("turn_id"), F.col("t.role").alias("speaker"), F.col("t.content").alias("text"), "date_time", "n", "i", "t.has_answer")
    gold = rows.where("has_answer").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "i", "turn_id"))), lambda x: x["turn_id"]).alias("gold"))
    asked = doc.select("question_id", "conversation_id", "question", "question_date", "question_type").join(gold, "question_id", "left")
    asked = asked.select(
        F.col("question_id").alias("query_id"),
        "conversation_id",
        "question",
        "question_date",
        F.when(~abstains(F.col("question_id")), F.coalesce("gold", F.array().cast("array<string>"))).alias("evidence"),
        F.col("question_type").alias("grp"),
    )
    return Dataset(_numbered(rows, "n", "i").select(*_TURNS), asked)


def abstains(question_id: Column) -> Column:
    return question_id.endswith(ABSTAINS)


def gold_sessions(spark: SparkSession, path: str) -> DataFrame:
    """query_id and the sessions that hold its answer; null for questions without one."""
    doc = _documents(spark, path, LONGMEMEVAL, True)
    return doc.select(F.col("question_id").alias("query_id"), F.when(~abstains(F.col("question_id")), F.col("answer_session_ids")).alias("sessions"))


READERS = {"fixtures": fixtures, "locomo": locomo, "longmemeval_s": longmemeval}


def load(spark: SparkSession, name: str, path: str | None = None) -> Dataset:
    if name not in READERS:
        raise ValueError(f"no dataset is called {name}; there are {', '.join(READERS)}")
    explicit = path or (os.environ.get("FIXTURES_PATH") if name == "fixtures" else None)
    return READERS[name](spark, find_file(explicit, FILES[name]))
