"""Mixing sources to target weights by capped water-filling.

A source's share is its weight's part of the total. Sources whose share exceeds ``max_epochs`` times
their size are clamped there and the excess is shared again among the rest, by weight, until no source
is above. Clamping only raises the level of the others, so a round clamps every source that the level
has passed, and the level of the next round comes from sums over the sources: no source is ranked, and
what the driver sees of a round is one row.

Sampling: a source whose target is e times its size repeats every document floor(e) times. The
remaining fraction is one more repetition of some documents, chosen by a seeded hash of the id: the
source's documents are dealt into about the square root of their number of hash buckets, buckets are
taken whole in order while they fit, and of the eight from the first that does not fit the documents
are taken one by one, in seeded order, if they still fit. No task holds more of a
source than its bucket sums or the documents of eight buckets: a few square roots of its number of documents.

Cases, all defined: a null text has size 0; a null source is a source, ordered last; a null id is
hashed like any other. Repeated rows (same source, id and size) count as often as they occur and are all treated alike. A source of no words has target 0. An
empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import WORD_PATTERN
from millrace.session import cut_lineage

SEED = 20
#: Up to so many sources and bytes of their names the per-source table is broadcast; beyond, it is joined by salted shuffle.
BROADCAST_SOURCES, BROADCAST_NAME_BYTES = 100_000, 16_000_000
SALTS = 64
#: Buckets from which the last words of a quota are picked document by document.
OPEN_BUCKETS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """``source, weight``: the weights in turn over the sources by code point, null last."""
    order = F.col("source").asc_nulls_last()
    part = F.spark_partition_id().alias("part")
    ranged = cut_lineage(sources.select("source").repartitionByRange(order).select("source", part))
    # One row for each task's range: how many sources stand before it.
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    nth = F.col("start") + F.col("inside")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(starts), "part")
    return numbered.select("source", F.element_at(cycle, (nth % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``; the targets add up to ``share`` of all sizes if the caps allow."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sizes.agg(F.sum("source_size") * share).first()[0] or 0.0
    level = 0.0
    while True:
        # The sources that the level does not fill up share what the others' caps leave.
        free = F.col("weight") * F.lit(level) < cap
        held = sizes.agg(F.sum(F.when(~free, cap)).alias("caps"), F.sum(F.when(free, F.col("weight"))).alias("weights")).first()
        if not held["weights"]:
            level = float("inf")
            break
        risen = (total - (held["caps"] or 0.0)) / held["weights"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    target = F.when(F.col("weight") > 0, F.least(cap, F.col("weight") * F.lit(level))).otherwise(0.0)
    return sizes.select("source", "source_size", "n_docs", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def id_hash(doc_id: Column) -> Column:
    """The seeded hash by which a source's documents are ordered."""
    return F.xxhash64(F.lit(SEED), doc_id)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, id, size, id_hash`` of every row: all that planning needs of the texts."""
    return docs.select(
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        id_hash(F.col(id_col)).alias("id_hash"),
    )


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source, which are few enough to broadcast or else met by salt."""
    right = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    size = right.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("_source")).alias("bytes")).first()
    if size["rows"] <= BROADCAST_SOURCES and (size["bytes"] or 0) <= BROADCAST_NAME_BYTES:
        return rows.join(F.broadcast(right), same).drop("_source")
    salted = right.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod("id_hash", F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("_salt") == F.col("_to"))).drop("_source", "_to", "_salt")


def _bucket() -> Column:
    hash_bits = F.shiftrightunsigned("id_hash", 8)
    return F.pmod(hash_bits, F.ceil(F.sqrt("n_docs")).cast("long")).alias("bucket")


def plan_sources(measured: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row for each source: its target, whole repetitions, the first bucket that does not fit and the words left to take."""
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sizes = cut_lineage(sizes)
    weighed = cyclic_weights(sizes, weights).withColumnRenamed("source", "_source")
    joined = sizes.join(weighed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut_lineage(
        water_fill(joined, share, max_epochs)
        .withColumn("whole", whole)
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    buckets = (
        _with_sources(measured, targets.select("source", "n_docs", "quota"))
        .groupBy("source", "quota", _bucket())
        .agg(F.sum("size").alias("words"))
    )
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    split = (
        buckets.withColumn("upto", upto)
        .where(F.col("upto") > F.col("quota"))
        .groupBy(F.col("source").alias("_source"))
        .agg(F.min(F.struct("bucket", (F.col("quota") - F.col("upto") + F.col("words")).alias("gap"))).alias("split"))
    )
    planned = targets.join(split, F.col("source").eqNullSafe(F.col("_source")), "left")
    n_buckets = F.ceil(F.sqrt("n_docs")).cast("long")
    return cut_lineage(
        planned.select(
            "source",
            "source_size",
            "n_docs",
            "target",
            "whole",
            F.when(F.col("quota") > 0, F.coalesce("split.bucket", n_buckets)).otherwise(-OPEN_BUCKETS).alias("split_bucket"),
            F.coalesce("split.gap", F.lit(0.0)).alias("gap"),
        )
    )


def _fill_gap(pool: pd.DataFrame) -> pd.DataFrame:
    """Of one source's open buckets, the documents that still fit the gap, in seeded order; one more if that comes nearer."""
    gap = float(pool["gap"].iloc[0])
    ordered = pool.sort_values(["bucket", "id_hash", "size"], kind="stable")
    fits = []
    for words in ordered["words"]:
        fits.append(words <= gap)
        gap -= words if fits[-1] else 0
    ordered["extra"] = fits
    left_out = ordered[~ordered["extra"]]
    if len(left_out) and left_out["words"].min() < 2 * gap:
        ordered.loc[left_out["words"].idxmin(), "extra"] = True
    return ordered[["id_hash", "size", "source_hash", "extra"]]


def _is_open() -> Column:
    return F.col("bucket").between(F.col("split_bucket"), F.col("split_bucket") + OPEN_BUCKETS - 1)


def choose(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """``id_hash, size, source_hash, extra`` for the documents of open buckets, which no rule on the bucket alone decides."""
    pool = _with_sources(measured, sources).withColumn("bucket", _bucket()).where(_is_open())
    alike = pool.groupBy(F.xxhash64("source").alias("source_hash"), "source", "bucket", "id_hash", "size", "gap").agg(
        F.sum("size").alias("words")
    )
    schema = "id_hash long, size long, source_hash long, extra boolean"
    return cut_lineage(alike.drop("source").groupBy("source_hash").applyInPandas(_fill_gap, schema))


def repeat(measured: DataFrame, sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``measured``, whatever further columns they have, with ``source_size, target`` and ``repeats``."""
    placed = _with_sources(measured, sources).withColumn("bucket", _bucket())
    outside = placed.where(~_is_open()).withColumn("_extra", F.col("bucket") < F.col("split_bucket"))
    decided = chosen.select(
        F.col("id_hash").alias("_h"), F.col("size").alias("_s"), F.col("source_hash").alias("_o"), F.col("extra").alias("_extra")
    )
    inside = placed.where(_is_open()).join(
        decided,
        (F.col("id_hash") == F.col("_h")) & (F.col("size") == F.col("_s")) & (F.xxhash64("source") == F.col("_o")),
    )
    both = outside.unionByName(inside.drop("_h", "_s", "_o"))
    repeats = (F.col("whole") + F.col("_extra").cast("long")).alias("repeats")
    kept = [c for c in measured.columns if c != "id_hash"]
    return both.select(*kept, "source_size", "target", repeats)
