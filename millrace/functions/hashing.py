"""Digests, framed preimages and hash-derived draws, as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def framed(domain: str, parts: Sequence[Column]) -> Column:
    """A domain, a zero byte, and each part's bytes behind their length as eight bytes: no two lists of parts collide."""
    out = [F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00"))]
    for part in parts:
        raw = F.encode(part, "UTF-8")
        out += [F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw]
    return F.concat(*out)


def joined_key(parts: Sequence[Column]) -> Column:
    """SHA-256 of the parts with a zero byte between; null if a part is, so that no key stands for two lists of parts."""
    zero = F.lit("\0")
    return F.sha2(F.concat(parts[0], *(x for part in parts[1:] for x in (zero, part))), 256)


def draw_u64(seed: Column, stream: Column) -> Column:
    """The first eight digest bytes of seed and stream as an unsigned number."""
    return F.conv(F.substring(joined_key([seed, stream]), 1, 16), 16, 10).cast("decimal(20,0)")


def modulo(hex_digest: Column, m: int) -> Column:
    """A whole 256-bit digest modulo a small number, digit by digit."""
    digits = F.split(hex_digest, "")
    step = lambda acc, d: ((acc * 16 + F.conv(d, 16, 10).cast("int")) % m).cast("int")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), step)


def rotated(values: Column, hex_digest: Column) -> Column:
    """An array turned left by the first eight digits modulo its length."""
    by = (F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long") % F.size(values)).cast("int")
    return F.concat(F.slice(values, by + 1, F.size(values) - by), F.slice(values, F.lit(1), by))
