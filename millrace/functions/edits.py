"""What changed between two revisions of a text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an input hint says about the edit.
HINTS = {
    "insertText": "insert",
    "insertCompositionText": "insert",
    "insertFromDrop": "insert",
    "insertFromPaste": "paste",
    "insertReplacementText": "replace",
    "deleteContentBackward": "delete",
    "deleteContentForward": "delete",
    "deleteByCut": "delete",
}


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def changed_kind(before: str, after: str) -> str:
    if before == after:
        return "none"
    prefix = _common(before, after)
    left, right = before[prefix:], after[prefix:]
    suffix = _common(left[::-1], right[::-1])
    removed, inserted = len(left) - suffix, len(right) - suffix
    return "insert" if not removed else "delete" if not inserted else "replace"


@F.pandas_udf(T.StringType())
def diff_kind(before: pd.Series, after: pd.Series) -> pd.Series:
    """insert, delete, replace or none, from common prefix and suffix; a null before counts as empty."""
    return pd.Series([changed_kind(a or "", b or "") for a, b in zip(before, after, strict=True)])


def edit_kind(diff: Column, moved: Column, hint: Column) -> Column:
    """The kind of an edit: a hint counts only where it agrees with the difference, and may tell a paste from other insertions."""
    table = F.create_map(*(x for pair in HINTS.items() for x in map(F.lit, pair)))
    hinted = F.try_element_at(table, hint)
    return F.when(diff == "none", F.when(moved, "cursor_move").otherwise("none")).when(
        (diff == "insert") & (hinted == "paste"), "paste"
    ).otherwise(diff)


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio over words, 2 * matched / total."""
    return pd.Series([SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])
