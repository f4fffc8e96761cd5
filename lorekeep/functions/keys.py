"""Ids, hashes and the envelope that a text is kept in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVELOPE = ("conversation_id", "session_id", "turn_id", "speaker", "text", "date_time")
_LEFT_OUT_IF_EMPTY = ("speaker", "date_time")


def _escaped(json: Column) -> Column:
    """Signs that mean something in HTML, and the two line separators of Unicode, as escapes."""
    for sign in ("&", "<", ">", " ", " "):
        json = F.replace(json, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return json


def envelope(**columns: Column) -> Column:
    """Canonical JSON, fields always in the order of ENVELOPE."""
    fields = []
    for name in ENVELOPE:
        value = F.coalesce(columns.get(name, F.lit(None)).cast("string"), F.lit(""))
        fields.append((F.nullif(value, F.lit("")) if name in _LEFT_OUT_IF_EMPTY else value).alias(name))
    return _escaped(F.to_json(F.struct(*fields)))


def parse_envelope(json: Column) -> Column:
    return F.from_json(json, ", ".join(f"{name} string" for name in ENVELOPE))


def content_hash(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def blob_key(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def cache_key(prefix: Column, text: Column) -> Column:
    """Of the text with its prefix: the same text as document and as query are two."""
    return content_hash(F.concat(prefix, text))


def surrogate_id(dataset: Column, sample: Column) -> Column:
    """The first 8 bytes of the hash of dataset/sample as a positive number; 0, which means all conversations, becomes 1."""
    digits = F.sha2(F.concat_ws("/", dataset, sample).cast("binary"), 256)
    top = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int") % 8
    number = F.conv(F.concat(F.hex(top), F.substring(digits, 2, 15)), 16, 10).cast("bigint")
    return F.greatest(number, F.lit(1))


def turn_id(session: Column, position: Column) -> Column:
    return F.concat_ws("_", session, position)


def truncate_utf8(text: Column, most: int = 1200) -> Column:
    """The text up to so many bytes, cut between characters; as in UTF-8, a byte 10xxxxxx begins none."""
    data = F.substring(text.cast("binary"), 1, most)
    whole = F.octet_length(text) <= most
    # what is left of a character that was cut decodes to a replacement sign
    return F.when(whole, text).otherwise(F.regexp_replace(data.cast("string"), "�+$", ""))
