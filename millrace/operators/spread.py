"""Ordered work on sessions of any length: running sums, successors and jump pointers, with no session in one task.

Rows are dealt by ranges of (session, order), so a long session lies over as many tasks as its rows need. What is local
to a range is a window over (session, range); what crosses ranges is one row for each session and range, of which only
the sessions that a range boundary cuts matter, two for each task at most and one for each range of a long session.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import Rounds, cut_lineage

MAX_DOUBLINGS = 63


def deal(rows: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """Add ``_part``, the range of (session, order) that a row lies in, and write the rows out."""
    return cut_lineage(rows.repartitionByRange(session, *order).withColumn("_part", F.spark_partition_id()))


def _of_cut_sessions(rows: DataFrame, session: str, columns: Mapping[str, Column], where: str) -> DataFrame:
    return rows.select(F.col(session).alias("_session"), F.col("_part").alias("_at"), *(c.alias(n) for n, c in columns.items())).where(where)


def _with(rows: DataFrame, facts: DataFrame, session: str) -> DataFrame:
    on = rows[session].eqNullSafe(facts["_session"]) & (rows["_part"] == facts["_at"])
    return rows.join(facts, on, "left").drop("_session", "_at")


def running(dealt: DataFrame, session: str, order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Add a running sum under each name, the row itself included; ``sums`` gives the column that it adds up."""
    totals = dealt.groupBy(session, "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(session).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = _of_cut_sessions(totals, session, {f"_before_{n}": F.sum(n).over(earlier) for n in sums}, " OR ".join(f"_before_{n} <> 0" for n in sums))
    local = Window.partitionBy(session, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _with(dealt.withColumns({f"_local_{n}": F.sum(c).over(local) for n, c in sums.items()}), before, session)
    zero = F.lit(0).cast("long")
    made = {n: F.col(f"_local_{n}") + F.coalesce(F.col(f"_before_{n}"), zero) for n in sums}
    return summed.withColumns(made).drop(*(f"_{k}_{n}" for n in sums for k in ("local", "before")))


def number(rows: DataFrame, session: str, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Add ``name``: dense from 0 in each session. The result keeps ``_part``."""
    dealt = deal(rows, session, order).withColumn("_one", F.lit(1).cast("long"))
    return running(dealt, session, order, {name: "_one"}).withColumn(name, F.col(name) - 1).drop("_one")


def successors(rows: DataFrame, session: str, value: str, seq: str, targets: Mapping[str, Column]) -> DataFrame:
    """``rows`` with, under each name, the least ``seq`` of its session whose ``value`` is the target or more; null if there is none.

    ``value`` must not fall as ``seq`` rises. A target is looked up among the values of its own range, and failing that is the
    first row of the session in a later one.
    """
    out = rows
    for name, target in targets.items():
        asked = rows.select(F.col(session), target.alias("_value"), F.lit(0).alias("_is_row"), F.col(seq).alias("_seq"))
        held = rows.select(F.col(session), F.col(value).alias("_value"), F.lit(1).alias("_is_row"), F.col(seq).alias("_seq"))
        order = ["_value", "_is_row", "_seq"]
        dealt = deal(asked.unionByName(held), session, order)
        row_seq = F.when(F.col("_is_row") == 1, F.col("_seq"))
        firsts = dealt.groupBy(session, "_part").agg(F.min(row_seq).alias("_first"))
        # Both run backwards: a frame that ends with its partition would be gone through anew for each row.
        after = Window.partitionBy(session).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        later = _of_cut_sessions(firsts, session, {"_later": F.last("_first", ignorenulls=True).over(after)}, "_later IS NOT NULL")
        backwards = Window.partitionBy(session, "_part").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
        found = _with(dealt.withColumn("_next", F.last(row_seq, ignorenulls=True).over(backwards)).where("_is_row = 0"), later, session)
        found = found.select(F.col(session).alias("_s"), F.col("_seq").alias("_q"), F.coalesce("_next", "_later").alias(name))
        out = out.join(found, out[session].eqNullSafe(found["_s"]) & (out[seq] == found["_q"])).drop("_s", "_q")
    return out


def reached(links: DataFrame, starts: DataFrame, session: str, seq: str, following: str) -> DataFrame:
    """``session, seq`` of all rows that the pointers ``following`` lead to from ``starts``, these included.

    Pointer doubling: after k rounds a pointer stands for 2 ** k steps, and all rows within so many steps are known. So there are as
    many rounds as the longest chain has binary digits, each of two joins on (session, seq), however long a session is.
    Every pointer must lead forward.
    """
    of_jumps, of_seen = Rounds(), Rounds()
    jumps = of_jumps.next(links.select(session, seq, following).where(F.col(following) > F.col(seq)))
    seen = of_seen.next(starts.select(session, seq))
    for _ in range(MAX_DOUBLINGS):
        if jumps.isEmpty():
            return seen
        ahead = jumps.select(F.col(session).alias("_s"), F.col(seq).alias("_q"), F.col(following).alias("_to"))
        found = seen.join(ahead, seen[session].eqNullSafe(ahead["_s"]) & (seen[seq] == ahead["_q"]))
        seen = of_seen.next(seen.unionByName(found.select(session, F.col("_to").alias(seq))))
        twice = jumps.join(ahead, jumps[session].eqNullSafe(ahead["_s"]) & (jumps[following] == ahead["_q"]))
        jumps = of_jumps.next(twice.select(session, seq, F.col("_to").alias(following)))
    raise RuntimeError(f"pointers go on after {MAX_DOUBLINGS} doublings")


def grouped_from(rows: DataFrame, starts: DataFrame, session: str, seq: str, name: str) -> DataFrame:
    """Add ``name``: how many of ``starts(session, seq)`` stand at or before a row, less one. Rows keep their ``_part``."""
    marks = starts.select(F.col(session).alias("_s"), F.col(seq).alias("_q"), F.lit(1).cast("long").alias("_starts"))
    marked = rows.join(marks, rows[session].eqNullSafe(marks["_s"]) & (rows[seq] == marks["_q"]), "left").drop("_s", "_q")
    counted = running(cut_lineage(marked.fillna(0, ["_starts"])), session, [seq], {name: "_starts"})
    return counted.withColumn(name, F.col(name) - 1).drop("_starts")


def packed(rows: DataFrame, session: str, order: Sequence[str], caps: Mapping[str, int], name: str = "shard") -> DataFrame:
    """Consecutive rows packed as long as no cap is passed; a row that passes one alone has a pack of its own.

    Adds ``seq``, ``name`` and, as ``held_<column>``, what the pack holds of each column of ``caps`` up to the row.
    """
    sums = {f"_upto_{c}": c for c in caps}
    placed = number(rows, session, order)
    placed = cut_lineage(running(placed, session, ["seq"], sums))
    full = placed
    for c, cap in caps.items():
        full = successors(full, session, f"_upto_{c}", "seq", {f"_full_{c}": F.col(f"_upto_{c}") - F.col(c) + cap + 1})
    full_at = F.array_min(F.array(*(F.col(f"_full_{c}") for c in caps)))
    following = F.when(full_at.isNotNull(), F.greatest(full_at, F.col("seq") + 1))
    first = placed.where("seq = 0").select(session, "seq")
    starts = reached(full.withColumn("_following", following), first, session, "seq", "_following")
    grouped = cut_lineage(grouped_from(placed, starts, session, "seq", name))
    own = grouped.groupBy(session, name).agg(*(F.min(F.col(s) - F.col(c)).alias(f"_base_{c}") for s, c in sums.items()))
    own = own.withColumnsRenamed({session: "_s", name: "_n"})
    met = grouped.join(own, grouped[session].eqNullSafe(own["_s"]) & (grouped[name] == own["_n"]))
    held = {f"held_{c}": F.col(s) - F.col(f"_base_{c}") for s, c in sums.items()}
    return met.withColumns(held).drop("_s", "_n", "_part", *sums, *(f"_base_{c}" for c in caps))


def sampled(log: DataFrame, session: str, order: Sequence[str], at: str, throttle: int, pause: int, hint: str) -> DataFrame:
    """What a trailing-throttle sampler emits: ``session, activity, window, first_seq, last_seq, emitted, hint``.

    The first row of a session attaches the sampler: it is emitted at once and is no activity. An activity opens a window if none is
    open; the window emits its latest state when ``throttle`` has passed since, with the last hint that came within it. When ``pause``
    has passed since the last row, an open window is emitted first, and then one paused frame; paused frames have the number of
    their last row's window, -1 for the attaching row. An activity at the very time that a window ends opens the next.
    """
    placed = cut_lineage(number(log, session, order))
    nexts = placed.select(F.col(session).alias("_s"), (F.col("seq") - 1).alias("_q"), F.col(at).alias("_next_at"))
    rows = cut_lineage(placed.join(nexts, placed[session].eqNullSafe(nexts["_s"]) & (placed["seq"] == nexts["_q"]), "left").drop("_s", "_q"))
    quiet = F.coalesce(F.col("_next_at") - F.col(at) >= pause, F.lit(True))
    # The number of rests before a row rises by one after each; the first row beyond the next rest has that number and one.
    rested = running(rows.withColumn("_rests", quiet.cast("long")), session, ["seq"], {"_upto": "_rests"})
    rested = cut_lineage(rested.withColumn("_rest", F.col("_upto") - F.col("_rests")))
    acts = rested.where("seq > 0")
    far = successors(acts, session, at, "seq", {"_late": F.col(at) + throttle})
    far = successors(far, session, "_rest", "seq", {"_after_rest": F.col("_rest") + 1})
    links = far.withColumn("_following", F.least("_late", "_after_rest"))
    starts = reached(links, acts.where("seq = 1"), session, "seq", "_following")
    inside = cut_lineage(grouped_from(rested.select(*placed.columns, "_next_at"), starts, session, "seq", "window"))
    opened = inside.where("seq > 0").groupBy(session, "window").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min(at).alias("_open"), F.max(at).alias("_last"),
        F.max(F.when(F.col(hint).isNotNull(), F.struct("seq", hint)))[hint].alias("hint"),
    )
    activity = lambda name: F.lit(name).alias("activity")
    due = F.least(F.col("_open") + throttle, F.col("_last") + pause).alias("emitted")
    active = opened.select(session, activity("active"), "window", "first_seq", "last_seq", due, "hint")
    none = F.lit(None).cast(log.schema[hint].dataType).alias("hint")
    attached = inside.where("seq = 0").select(session, activity("active"), "window", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.col(at).alias("emitted"), none)
    paused = inside.where(quiet).select(session, activity("paused"), "window", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), (F.col(at) + pause).alias("emitted"), none)
    return active.unionByName(attached).unionByName(paused)
