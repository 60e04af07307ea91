"""Metrics of how a session was written and answered: input, sampled frames, and decisions with what arrived before them.

Counts are given as numerators and denominators, which add up over sessions; lists of values are given as rows,
which aggregates.summary() turns into percentiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import utf16
from millrace.operators.sequence import ordered


def paste(inputs: DataFrame, session: str, input_type: str, data: str) -> DataFrame:
    """Per session the pastes among all inputs, the UTF-16 length of what they brought, and whether there was one."""
    is_paste = F.col(input_type) == "insertFromPaste"
    sums = inputs.groupBy(session).agg(
        F.count_if(is_paste).alias("pastes"), F.count(F.lit(1)).alias("inputs"), F.sum(F.when(is_paste, utf16.units(F.col(data)))).alias("pasted_chars")
    )
    return sums.withColumn("paste_rate", F.col("pastes") / F.col("inputs")).withColumn("paste_seen", F.col("pastes") > 0)


def values_of(rows: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``metric, value`` for each row and each of ``values`` that is not null."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in values.items()))
    return rows.select(F.explode(each).alias("m")).select("m.*").where("value IS NOT NULL")


def rates_of(rows: DataFrame, conditions: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``metric, num, den, rate`` over all rows: those of the second condition, and of these those of the first."""
    sums = []
    for name, (passed, among) in conditions.items():
        sums += [F.count_if(among & passed).alias(f"{name}_num"), F.count_if(among).alias(f"{name}_den")]
    one = rows.agg(*sums)
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}_num").alias("num"), F.col(f"{n}_den").alias("den")) for n in conditions))
    found = one.select(F.explode(each).alias("m")).select("m.*")
    return found.withColumn("rate", F.when(F.col("den") > 0, F.round(F.col("num") / F.col("den"), 6)))


def sampled_changes(frames: DataFrame, session: str, order: Sequence[str], at_ms: str, text: str, cursor: str) -> DataFrame:
    """Each frame after a session's first with what changed since the frame before: time, length, text, cursor."""
    before = {c: F.lag(c).over(ordered(session, order)) for c in (at_ms, text, cursor)}
    held = frames.withColumns({f"_{c}": column for c, column in before.items()}).where(F.col(f"_{at_ms}").isNotNull())
    return held.select(
        session, *order, (F.col(at_ms) - F.col(f"_{at_ms}")).alias("snapshot_dt_ms"),
        (utf16.units(F.col(text)) - utf16.units(F.col(f"_{text}"))).alias("text_length_delta_chars"),
        F.abs(F.col(cursor) - F.col(f"_{cursor}")).alias("cursor_distance_utf16"), (F.col(text) == F.col(f"_{text}")).alias("unchanged"),
    )


def arrivals(log: DataFrame, session: str, order: str, at: str, kind: str, decision: str, finished: str, snapshot: str) -> DataFrame:
    """What arrived for each decision: ``decision`` (its number in the session), ``busy`` and ``replaced``.

    Rows up to a decision arrive for it. One is busy if it came before the decision before had ended, and replaced
    if a later snapshot came for the same decision. Rows after a session's last decision have none.
    """
    is_decision = F.col(kind) == decision
    by = ordered(session, [order])
    number = F.coalesce(F.sum(is_decision.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ended = F.last(F.when(is_decision, F.col(finished)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    placed = log.withColumn("decision", number).withColumn("busy", F.coalesce(F.col(at) < ended, F.lit(False)))
    of_decision = Window.partitionBy(session, "decision")
    last = F.max(F.when(F.col(kind) == snapshot, F.col(order))).over(of_decision)
    decided = F.max(F.when(is_decision, F.col(at))).over(of_decision)
    found = placed.withColumn("replaced", (F.col(kind) == snapshot) & (F.col(order) < last)).withColumn("decided_at", decided)
    return found.where(~is_decision & F.col("decided_at").isNotNull())
