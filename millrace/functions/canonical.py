"""Canonical JSON: one byte string for each value, with limits and rejections."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of an event payload.
MAX_DEPTH, MAX_MEMBERS, MAX_ELEMENTS, MAX_STRING_BYTES, MAX_BYTES, MAX_INTEGER = 8, 64, 64, 4096, 16_384, 2**53 - 1


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _within(value: object, depth: int = 1) -> bool:
    """Whether all limits hold; ``depth`` is that of ``value`` if it is a container, and no scalar adds to it."""
    if depth > MAX_DEPTH and isinstance(value, (dict, list)):
        return False
    if isinstance(value, str):
        return len(value.encode("utf-8", "surrogatepass")) <= MAX_STRING_BYTES and not any(0xD800 <= ord(c) <= 0xDFFF for c in value)
    if isinstance(value, dict):
        return len(value) <= MAX_MEMBERS and all(_within(k, depth) and _within(v, depth + 1) for k, v in value.items())
    if isinstance(value, list):
        return len(value) <= MAX_ELEMENTS and all(_within(v, depth + 1) for v in value)
    return value is None or isinstance(value, bool) or isinstance(value, int) and abs(value) <= MAX_INTEGER


def _ordered(value: object) -> object:
    if isinstance(value, dict):
        return {k: _ordered(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be"))}
    return [_ordered(v) for v in value] if isinstance(value, list) else value


def canonical(text: str | None) -> str | None:
    """Keys by UTF-16 unit, no spaces, no fractions, no repeated keys, within the limits; None for anything else."""
    if text is None:
        return None
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_float=lambda _: (_ for _ in ()).throw(ValueError("fraction")), parse_constant=lambda _: (_ for _ in ()).throw(ValueError("constant")))
    except (ValueError, RecursionError):
        return None
    if not _within(value):
        return None
    out = json.dumps(_ordered(value), ensure_ascii=False, separators=(",", ":"))
    return out if len(out.encode()) <= MAX_BYTES else None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def sealed(columns: Sequence[str]) -> Column:
    """Digest of a row's columns as JSON in the order of their names."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def recursive_scalars(value: object) -> list[str]:
    if isinstance(value, dict):
        return [s for v in value.values() for s in recursive_scalars(v)]
    if isinstance(value, list):
        return [s for v in value for s in recursive_scalars(v)]
    return [json.dumps(value)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def scalars(texts: pd.Series) -> pd.Series:
    """All scalar values anywhere in a JSON text, in order; none of a null, and null of a malformed text."""

    def one(text: str | None) -> list[str] | None:
        try:
            return [] if text is None else recursive_scalars(json.loads(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)
