"""Hashes and ids of chunks and notes, and ages of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import constants as C


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, index.cast("string")), 256)


def note_id(text: Column, at: Column) -> Column:
    """Sixteen hex digits from a note's text and its time as text."""
    return F.substring(F.sha2(F.concat(text, at), 256), 1, 16)


def tagged(text: Column, tags: Column) -> Column:
    """The text under a line of its tags (comma-separated), if it has any."""
    listed = F.array_join(F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != ""), ", ")
    return F.when(F.coalesce(listed, F.lit("")) != "", F.concat(F.lit("[tags: "), listed, F.lit("]\n"), text)).otherwise(text)


def is_note_id(target: Column) -> Column:
    return target.startswith(C.NOTE_PREFIX) | target.rlike("^[0-9a-f]{16}$")


def age(at: Column, now: Column) -> Column:
    """How long ago, in words; "unknown" for null."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    told = F.when(s < 60, F.lit("just now")).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago")))
    return F.when(at.isNull(), F.lit("unknown")).otherwise(told.otherwise(F.concat(F.floor(s / 86400), F.lit("d ago"))))


def is_stale(at: Column, now: Column, days: int = 7) -> Column:
    return F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400) >= days, F.lit(False))
