"""Token estimates, costs and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def over_budget(n_tokens: Column, budget: int, permille: int) -> Column:
    return n_tokens * 1000 >= budget * permille


def cost(n_tokens: Column, per_million: str) -> Column:
    """Exact price of tokens, to six places half to even."""
    exact = n_tokens.cast("decimal(20,0)") * F.lit(per_million).cast("decimal(10,4)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.bround(exact.cast("decimal(38,12)"), 6)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def age_ms(now_ns: Column, then_ns: Column) -> Column:
    """Whole milliseconds between two clock readings, rounded down also below zero."""
    return F.floor((now_ns - then_ns) / 1_000_000).cast("long")
