"""Top rows by group: earliest, unique minimum, stratified and hash-ranked samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Of each group the ``carry`` columns of the least row by ``order``, by one aggregation without a sort."""
    best = F.min_by(F.struct(*carry), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def unique_minimum(rows: DataFrame, keys: Sequence[str], order: str, subject: str) -> DataFrame:
    """Of each group the subject of least ``order``, and whether several share it."""
    least = F.min(order).over(Window.partitionBy(*keys))
    at_least = rows.withColumn("_least", least).where(F.col(order) == F.col("_least"))
    found = at_least.groupBy(*keys).agg(F.min(subject).alias(subject), F.count_distinct(subject).alias("_n"))
    return found.select(*keys, subject, (F.col("_n") > 1).alias("ambiguous"))


def hash_rank(key: Column, domain: str) -> Column:
    """A stable pseudo-random order: SHA-256 of a domain, a zero byte and the key."""
    return F.sha2(F.concat(F.lit(f"{domain}\0"), key.cast("string")), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the place of each row in its group, from 1, however many rows a group has.

    Rows are dealt by ranges of (group, order), numbered within each task's range, and moved up by the rows of
    their group in the ranges before: a count for each group and range is all that is gathered.
    """
    keys = {f"_o{i}": column for i, column in enumerate(order)}
    keyed = rows.withColumns(keys)
    dealt = cut_lineage(keyed.repartitionByRange(group, *keys).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_group", "_at", F.coalesce(before, F.lit(0)).alias("_before")).where("_before > 0")
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*keys)))
    met = local.join(starts, local[group].eqNullSafe(starts["_group"]) & (local["_part"] == starts["_at"]), "left")
    place = F.col("_local").cast("long") + F.coalesce("_before", F.lit(0))
    return met.withColumn(name, place).drop("_part", "_local", "_group", "_at", "_before", *keys)


def stratified_share(rows: DataFrame, stratum: str, rank: Column, percent: int) -> DataFrame:
    """The first ceil(``percent`` %) of each stratum by ``rank``, a digest in hex digits.

    Rows are counted by the first four digits of their rank, which are spread evenly: a stratum has few such counts, and they say in which
    the last row taken lies. All rows below are taken as they come, and only that one in so many is put in order.
    """
    keyed = rows.withColumn("_rank", rank).withColumn("_digits", F.substring("_rank", 1, 4))
    counted = keyed.groupBy(F.col(stratum).alias("_stratum"), F.col("_digits").alias("_last")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_stratum").orderBy("_last").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy("_stratum"))})
    wanted = F.floor((F.col("_n") * percent + 99) / 100)
    reached = sums.withColumn("_wanted", wanted).where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_c") < F.col("_wanted")))
    limits = reached.select("_stratum", "_last", (F.col("_wanted") - F.col("_upto") + F.col("_c")).alias("_left"))
    met = keyed.join(limits, keyed[stratum].eqNullSafe(limits["_stratum"])).where(F.col("_digits") <= F.col("_last"))
    below = met.where(F.col("_digits") < F.col("_last"))
    edge = met.where(F.col("_digits") == F.col("_last")).withColumn("_nth", F.row_number().over(Window.partitionBy("_stratum").orderBy("_rank")))
    return below.unionByName(edge.where(F.col("_nth") <= F.col("_left")).drop("_nth")).select(*rows.columns)


def presented(candidates: DataFrame, group: str, key: Column) -> DataFrame:
    """Add ``position``: the candidates of a group in hash order."""
    return ranked(candidates, group, [key], "position")


def nearest_length(targets: DataFrame, pool: DataFrame, key: str, length: str, wanted: str, item: str) -> DataFrame:
    """For each target the item of its key nearest in length, ties to the smaller item; one pass over key groups.

    Only the nearest item at or below, and the nearest above, can win: each is a running value in length order.
    """
    asked = targets.select(key, F.col(wanted).alias("_len"), F.lit(1).alias("_ask"), F.lit(None).cast("struct<l:bigint,i:bigint>").alias("_item"))
    offered = pool.select(key, F.col(length).cast("long").alias("_len"), F.lit(0).alias("_ask"), F.struct(F.col(length).cast("long").alias("l"), F.col(item).cast("long").alias("i")).alias("_item"))
    both = asked.unionByName(offered.groupBy(key, "_len", "_ask").agg(F.min("_item").alias("_item")))
    below = Window.partitionBy(key).orderBy("_len", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(key).orderBy("_len", F.desc("_ask")).rowsBetween(1, Window.unboundedFollowing)
    seen = both.withColumn("_lo", F.last("_item", True).over(below)).withColumn("_hi", F.first("_item", True).over(above)).where("_ask = 1")
    gap = lambda c: F.struct(F.abs(F.col(f"{c}.l") - F.col("_len")).alias("d"), F.col(f"{c}.i").alias("i"))
    best = F.when(F.col("_lo").isNull(), gap("_hi")).when(F.col("_hi").isNull(), gap("_lo")).otherwise(F.least(gap("_lo"), gap("_hi")))
    return seen.select(key, F.col("_len").alias(wanted), best["i"].alias(item))
