"""Lengths, slices and offsets counted in UTF-16 code units, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(text: Column) -> Column:
    """Number of UTF-16 code units."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def piece(text: Column, start: Column, end: Column) -> Column:
    """The text between two unit offsets; null where an offset lies outside or splits a surrogate pair."""
    raw = F.encode(text, "UTF-16BE")
    cut = F.substring(raw, (2 * start + 1).cast("int"), (2 * (end - start)).cast("int"))
    whole = (start >= 0) & (start <= end) & (end <= units(text)) & ~splits_pair(text, start) & ~splits_pair(text, end)
    return F.when(whole, F.decode(cut, "UTF-16BE"))


def splits_pair(text: Column, offset: Column) -> Column:
    """Whether an offset stands between the two halves of a surrogate pair."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    return F.coalesce(F.substring(raw, (4 * offset + 1).cast("int"), F.lit(2)).between("DC", "DF"), F.lit(False))


def point_index(text: Column, offset: Column) -> Column:
    """The code point offset that a unit offset stands for; null where it splits a pair."""
    before = F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), (2 * offset).cast("int")), "UTF-16BE")
    inside = (offset >= 0) & (offset <= units(text)) & ~splits_pair(text, offset)
    return F.when(inside, F.char_length(before).cast("long"))
