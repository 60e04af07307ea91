"""Planning and grading of model calls, allocation proofs, and comparisons of sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_calls(probes: DataFrame, probe: str, variants: Sequence[str], positions: Sequence[str]) -> DataFrame:
    """One generation and one listwise call for each probe, and a pairwise one for each variant and position: ``probe, call, call_id``."""
    pairwise = [f"p.{v}.{p}" for v in variants for p in positions]
    calls = F.array(*map(F.lit, ["g", *pairwise, "l"]))
    each = probes.select(F.col(probe).alias("probe"), F.explode(calls).alias("call"))
    return each.withColumn("call_id", F.concat_ws(".", "call", F.col("probe").cast("string")))


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys with ``status``: ok, missing, unknown or repeated."""
    left = expected.groupBy(key).agg(F.count(F.lit(1)).alias("_e"))
    right = found.groupBy(key).agg(F.count(F.lit(1)).alias("_f"))
    status = F.when(F.col("_e").isNull(), "unknown").when(F.col("_f").isNull(), "missing").when((F.col("_e") > 1) | (F.col("_f") > 1), "repeated").otherwise("ok")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def to_retry(attempts: DataFrame, key: str, attempt: str, good: Column) -> DataFrame:
    """Keys whose first attempt is not good."""
    first = attempts.groupBy(key).agg(F.min_by(good, attempt).alias("_good"))
    return first.where(~F.coalesce("_good", F.lit(False))).select(key)


def grade(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add a column for each check, true only if it and all before it hold, and ``failed_at``, the first that fails."""
    so_far, out, failed = F.lit(True), {}, F.lit(None).cast("string")
    for name, check in checks.items():
        holds = F.coalesce(check, F.lit(False))
        failed = F.coalesce(failed, F.when(~holds, F.lit(name)))
        so_far = so_far & holds
        out[name] = so_far
    return rows.withColumns(out | {"failed_at": failed})


def job_status(events: DataFrame, job: str, order: str, status: str, rank: Mapping[str, int]) -> DataFrame:
    """State of each job from its events: the furthest status, the last event, and whether it ever fell back."""
    ranks = F.create_map(*(x for pair in rank.items() for x in map(F.lit, pair)))
    ranked = events.withColumn("_r", F.try_element_at(ranks, F.col(status)))
    before = F.max("_r").over(Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    marked = ranked.withColumn("_back", F.coalesce(F.col("_r") < before, F.lit(False)))
    return marked.groupBy(job).agg(F.max_by(status, F.struct("_r", order)).alias("furthest"), F.max(order).alias("last_event"), F.bool_or("_back").alias("fell_back"))


def anchored_subset(rows: DataFrame, keys: Sequence[str], anchor: Column, order: str, size: int) -> DataFrame:
    """``size`` rows of each group: the anchors first, then the rest, each in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_anchor"), order))
    return rows.withColumn("_anchor", anchor).withColumn("place", place).where(F.col("place") <= size).drop("_anchor")


def compare_sequences(left: DataFrame, right: DataFrame, key: str, order: str, at: str, tolerance: int, fields: Sequence[str]) -> DataFrame:
    """Differences of two sequences place by place: ``key, place, field``, where times may differ by the tolerance from the start."""
    def placed(df: DataFrame, side: str) -> DataFrame:
        by = Window.partitionBy(key).orderBy(order)
        start = F.min(at).over(Window.partitionBy(key))
        row = F.struct((F.col(at) - start).alias("at"), *fields)
        return df.select(key, F.row_number().over(by).alias("place"), row.alias(side))

    both = placed(left, "l").join(placed(right, "r"), [key, "place"], "full_outer")
    differs = [F.when(F.col("l").isNull() | F.col("r").isNull(), F.lit("missing"))]
    present = F.col("l").isNotNull() & F.col("r").isNotNull()
    differs.append(F.when(present & (F.abs(F.col("l.at") - F.col("r.at")) > tolerance), F.lit("at")))
    differs += [F.when(present & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]
    return both.select(key, "place", F.explode(F.array_compact(F.array(*differs))).alias("field"))


def expand_needs(beats: DataFrame, plans: DataFrame, key: str, beat: str) -> DataFrame:
    """A row for each beat of a plan's life with its status: live until ``terminal``, then ended; plans have ``birth, terminal``."""
    both = beats.join(plans, key).where(F.col(beat) >= F.col("birth"))
    return both.withColumn("status", F.when(F.col(beat) >= F.col("terminal"), "ended").otherwise("live"))


def allocation(units: DataFrame, target: DataFrame, family: str, source: str, amount: str, least: int, most: int) -> DataFrame:
    """Proof lines for each family: realised, target, units out of band, sources that fund more than one unit, and whether all holds."""
    funded = units.groupBy(family, source).agg(F.count(F.lit(1)).alias("_uses"), F.sum(amount).alias("_sum"), F.count_if(~F.col(amount).between(least, most)).alias("_out"))
    total = funded.groupBy(family).agg(F.sum("_sum").alias("realised"), F.sum("_out").alias("out_of_band"), F.count_if(F.col("_uses") > 1).alias("reused_sources"))
    held = (F.col("realised") == F.col("target")) & (F.col("out_of_band") == 0) & (F.col("reused_sources") == 0)
    return total.join(target, family).withColumn("holds", held)


def usage(records: Column, aliases: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Token counts out of a JSON record whose fields go by several names; 0 if none is there."""
    return {
        name: F.coalesce(*(F.get_json_object(records, path).cast("long") for path in paths), F.lit(0).cast("long"))
        for name, paths in aliases.items()
    }
