"""Text rules that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is the six ASCII characters below; all else makes up words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
EDGE_SPACE_PATTERN = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(ASCII_SPACE)), UPPER_ASCII, LOWER_ASCII)


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that no model learns from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
