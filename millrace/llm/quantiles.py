"""Quantiles by counting over fixed bins: sums come out the same in whatever order tasks merge them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bin, by which a quantile lies farther out than the exact one at most.
BIN = 0.0001


def ends(rows: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """``keys, n, low, high``: for each group, the number of its values and the bounds between which its quantiles lie.

    ``low`` is the lower edge of the bin of the value of rank ceil(low * n), 1 at least, ``high`` the upper edge of that of
    rank ceil(high * n). Null values are left out. A group has no more bins than its range of values has.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / BIN).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*keys))})

    def at(q: float):
        return F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * q)), F.col("_bin")))

    found = placed.groupBy(*keys).agg(F.max("_n").alias("n"), at(low).alias("_low"), at(high).alias("_high"))
    return found.select(*keys, "n", (F.col("_low") * BIN).alias("low"), ((F.col("_high") + 1) * BIN).alias("high"))
