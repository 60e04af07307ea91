"""Windows over ordered logs: numbering, gaps, bursts, runs, propagation, chains.

Every function takes a log with a session column and order columns and keeps the other columns. All of
them partition by the session, so one shuffle on it serves any number of them in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(session: str, order: Sequence[str]) -> Window:
    return Window.partitionBy(session).orderBy(*order)


def upto(session: str, order: Sequence[str]) -> Window:
    return ordered(session, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def number(log: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """Add ``seq``: dense from 0 in each session."""
    return log.withColumn("seq", (F.row_number().over(ordered(session, order)) - 1).cast("long"))


def elapsed(log: DataFrame, session: str, order: Sequence[str], at_us: str, segment: str | None = None) -> DataFrame:
    """Add ``dt_ms``: whole milliseconds since the row before, 0 where a session or segment starts."""
    keys = [session, segment] if segment else [session]
    before = F.lag(at_us).over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("dt_ms", F.coalesce(F.floor((F.col(at_us) - before) / 1000), F.lit(0)).cast("long"))


def segment(log: DataFrame, session: str, order: Sequence[str], starts: Column) -> DataFrame:
    """Add ``segment_index``, which rises by one at each row where ``starts`` holds."""
    return log.withColumn("segment_index", F.sum(starts.cast("long")).over(upto(session, order)))


def burst(log: DataFrame, session: str, order: Sequence[str], at_us: str, gap_us: int) -> DataFrame:
    """Add ``burst``: a new one starts where the gap is at least ``gap_us`` (not only above, as session windows have it)."""
    gap = F.col(at_us) - F.lag(at_us).over(ordered(session, order))
    starts = F.when(gap.isNull() | (gap >= gap_us), 1).otherwise(0)
    return log.withColumn("burst", F.sum(starts).over(upto(session, order)).cast("long"))


def burst_summary(log: DataFrame, session: str, order: Sequence[str], at_us: str, gap_us: int, weight: Column) -> DataFrame:
    """One row for each burst: rows, total weight and duration."""
    return (
        burst(log, session, order, at_us, gap_us)
        .groupBy(session, "burst")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(weight).alias("weight"),
            F.floor((F.max(at_us) - F.min(at_us)) / 1000).cast("long").alias("duration_ms"),
        )
    )


def runs(log: DataFrame, session: str, order: Sequence[str], inside: Column) -> DataFrame:
    """Lengths of maximal runs of consecutive rows where ``inside`` holds, the last one included: session, run, n."""
    island = F.sum(F.when(inside, 0).otherwise(1)).over(upto(session, order))
    marked = log.withColumn("_inside", inside).withColumn("_island", island).where("_inside")
    numbered = marked.groupBy(session, "_island").agg(F.count(F.lit(1)).alias("n"))
    run = F.row_number().over(Window.partitionBy(session).orderBy("_island"))
    return numbered.select(session, run.cast("long").alias("run"), "n")


def transitions(log: DataFrame, session: str, order: Sequence[str], state: str) -> DataFrame:
    """How often each state follows each: from_state, to_state, n."""
    before = F.lag(state).over(ordered(session, order))
    pairs = log.select(before.alias("from_state"), F.col(state).alias("to_state")).where("from_state IS NOT NULL")
    return pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def revisions(log: DataFrame, session: str, order: Sequence[str], size: str) -> DataFrame:
    """Add ``change`` of ``size`` against the row before and ``is_revision`` where it shrank; the comparison sees all rows."""
    change = F.col(size) - F.lag(size).over(ordered(session, order))
    return log.withColumn("change", change).withColumn("is_revision", F.coalesce(change < 0, F.lit(False)))


def lifecycles(log: DataFrame, session: str, order: Sequence[str], kind: str, start: str, end: str, at_us: str) -> DataFrame:
    """Start, what follows, end: session, lifecycle, duration_ms, n_between, and whether it was nested or left open."""
    opened = log.withColumn("lifecycle", F.sum((F.col(kind) == start).cast("long")).over(upto(session, order))).where("lifecycle > 0")
    first_end = F.min(F.when(F.col(kind) == end, F.struct(*order))).over(Window.partitionBy(session, "lifecycle"))
    inside = opened.withColumn("_end", first_end).where(F.col("_end").isNull() | (F.struct(*order) <= F.col("_end")))
    return inside.groupBy(session, "lifecycle").agg(
        F.when(F.max("_end").isNotNull(), F.floor((F.max(at_us) - F.min(at_us)) / 1000).cast("long")).alias("duration_ms"),
        (F.count(F.lit(1)) - 1 - F.count_if(F.col(kind) == end)).alias("n_between"),
        F.max("_end").isNull().alias("left_open"),
    )


def propagate(log: DataFrame, session: str, order: Sequence[str], text: str, direct: Column) -> DataFrame:
    """Add ``handled``: a direct mark, carried on while the text stays the same in consecutive rows."""
    changed = F.when(F.col(text).eqNullSafe(F.lag(text).over(ordered(session, order))), 0).otherwise(1)
    run = log.withColumn("_direct", direct).withColumn("_run", F.sum(changed).over(upto(session, order)))
    seen = F.max("_direct").over(Window.partitionBy(session, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("handled", F.coalesce(seen, F.lit(False))).drop("_direct", "_run")


def clock(log: DataFrame, session: str, order: Sequence[str], dt_ms: str) -> DataFrame:
    """Add ``elapsed_ms``, the running sum of ``dt_ms``."""
    return log.withColumn("elapsed_ms", F.sum(dt_ms).over(upto(session, order)))


def newest_within(log: DataFrame, session: str, order: Sequence[str], cost: Column, budget: int) -> DataFrame:
    """The newest rows whose costs add up to at most ``budget``; the first that overflows ends the tail."""
    newest_first = Window.partitionBy(session).orderBy(*(F.desc(c) for c in order))
    running = F.sum(cost).over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return log.withColumn("tail_cost", running).where(F.col("tail_cost") <= budget)


def breaks(log: DataFrame, session: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows where ``value`` does not follow the one before by exactly one."""
    step = F.col(value) - F.lag(value).over(ordered(session, order))
    return log.withColumn("step", step).where(F.col("step") != 1)


def rendered_segments(log: DataFrame, keys: Sequence[str], order: str, line: Column) -> DataFrame:
    """One row for each segment: its lines joined by LF in order, without one at the end."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return log.groupBy(*keys).agg(joined.alias("segment_text"), F.count(F.lit(1)).alias("n_events"))


def hash_chain(segments: DataFrame, session: str, segment_index: str) -> DataFrame:
    """Add the segment's hash and its predecessor's, null for the first."""
    hashed = segments.withColumn("segment_hash", F.concat(F.lit("sha256:"), F.sha2("segment_text", 256)))
    return hashed.withColumn("previous_hash", F.lag("segment_hash").over(ordered(session, [segment_index])))


def split_at(log: DataFrame, session: str, order: Sequence[str], at_us: str, fractions: Sequence[float], boundary: Column) -> DataFrame:
    """For each fraction of a session's time, the nearest row where ``boundary`` holds; ties go to the earlier: session, fraction, seq."""
    whole = Window.partitionBy(session)
    start, end = F.min(at_us).over(whole), F.max(at_us).over(whole)
    cuts = F.explode(F.array(*map(F.lit, fractions))).alias("fraction")
    spread = log.select(session, "seq", at_us, boundary.alias("_at"), start.alias("_s"), end.alias("_e")).where("_at").select("*", cuts)
    distance = F.abs(F.col(at_us) - F.col("_s") - F.floor(F.col("fraction") * (F.col("_e") - F.col("_s"))))
    return spread.groupBy(session, "fraction").agg(F.min_by("seq", F.struct(distance, "seq")).alias("seq"))


def nth_match(log: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: str) -> DataFrame:
    """Of each group the row whose place in order is the number in ``wanted``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("place", place.cast("long")).where(F.col("place") == F.col(wanted))


def round_robin(items: DataFrame, keys: Sequence[str], order: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Add ``label``: the labels in turn by rank in each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return items.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), (rank % len(labels) + 1).cast("int")))
