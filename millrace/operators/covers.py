"""Selections that feed back on themselves, in rounds over whole tables: greedy covers, and totals that programs reach exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import ranked
from millrace.session import cut_lineage

MAX_ROUNDS = 200


def greedy_cover(labels: DataFrame, item: str, label: str, rank: Column) -> DataFrame:
    """``item`` of a greedy cover: again and again the item with the most labels not yet covered, of equals the one of least ``rank``.

    ``labels`` has a row for each item and label; ``rank`` must differ from item to item. In a round every item is taken that is
    best at each of its uncovered labels. No item that shares a label with it can be taken before it, since gains only
    fall, so the rounds take just the items that one choice after the other takes. A label that any number of items hold is
    summed up before its rows meet.
    """
    left = cut_lineage(labels.select(F.col(item).alias("_item"), F.col(label).alias("_label"), rank.alias("_rank")).distinct())
    taken: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        gains = left.groupBy("_item").agg(F.count(F.lit(1)).alias("_gain"))
        met = cut_lineage(left.join(gains, "_item"))
        best = met.groupBy("_label").agg(F.min(F.struct((-F.col("_gain")).alias("_less"), "_rank", "_item")).alias("_best"))
        won = best.groupBy(F.col("_best._item").alias("_item"), (-F.col("_best._less")).alias("_gain")).agg(F.count(F.lit(1)).alias("_won"))
        now = cut_lineage(won.where("_won = _gain").select("_item"))
        covered = met.join(now, "_item", "left_semi").select("_label").distinct()
        left = cut_lineage(left.join(covered, "_label", "left_anti"))
        taken = now if taken is None else taken.unionByName(now)
    else:
        raise RuntimeError(f"the cover is not done after {MAX_ROUNDS} rounds")
    empty = labels.select(F.col(item)).limit(0)
    return empty if taken is None else taken.select(F.col("_item").alias(item))


def cover_and_fill(labels: DataFrame, item: str, label: str, rank: Column, least: float, preferred: float, most: float) -> DataFrame:
    """``item, in_cover``: a greedy cover of all labels, and further items by rank up to the preferred part of all.

    At least ceil(``least`` * n) and at most floor(``most`` * n) of the n items are taken; it is an error if the cover alone needs more.
    """
    items = cut_lineage(labels.groupBy(item).agg(F.min(rank).alias("_rank")))
    n = items.count()
    cover = cut_lineage(greedy_cover(labels, item, label, rank))
    n_cover = cover.count()
    low, high = -int(-n * least // 1), int(n * most // 1)
    wanted = max(min(max(int(n * preferred + 0.5), low), high), n_cover)
    if wanted > high:
        raise ValueError(f"{n_cover} items cover the strata, more than {high} of {n}")
    rest = items.join(cover, item, "left_anti")
    placed = ranked(rest.withColumn("_all", F.lit(0)), "_all", [F.col("_rank")], "_place")  # by ranges, in no one task
    filled = placed.where(F.col("_place") <= wanted - n_cover)
    return cover.select(item, F.lit(True).alias("in_cover")).unionByName(filled.select(item, F.lit(False).alias("in_cover")))


def exact_reach(programs: DataFrame, targets: DataFrame, family: str, program: str, counts: Sequence[str]) -> DataFrame:
    """Every total that whole programs reach without passing their family's target: ``family, counts..., uses``.

    ``programs`` has ``family, program`` and the counts of one use, ``targets`` a family's target of each. ``uses`` lists (program,
    times) by program; of all ways to a total it is the one that uses the first program least, then the second, and so on.

    A frontier of totals is extended by each program, and by two, four, eight... uses of it at once; what no one had reached, or not
    so, is the next frontier. Totals are dealt by their own values, so no family is a task, and both tables are written out in each round.
    """
    limit = targets.select(F.col(family).alias("_f"), *(F.col(c).alias(f"_limit_{c}") for c in counts))
    met = programs.select(family, program, *counts).join(limit, programs[family] == limit["_f"]).drop("_f")
    most = F.array_min(F.array(*(F.when(F.col(c) > 0, F.floor(F.col(f"_limit_{c}") / F.col(c))) for c in counts)))
    powers = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("_most").cast("double"))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    moves = met.withColumn("_most", most).where("_most >= 1").withColumn("_times", powers)
    moves = cut_lineage(moves.select(F.col(family).alias("_f"), F.col(program).alias("_program"), "_times", *((F.col(c) * F.col("_times")).alias(f"_add_{c}") for c in counts)))
    key = [family, *counts]
    numbered = moves.select("_f", "_program").distinct()
    # Programs are compared by their place in their family, the first weighing most.
    places = cut_lineage(ranked(numbered, "_f", [F.col("_program")], "_nth").select(F.col("_f").alias("_pf"), F.col("_program").alias("_pp"), F.col("_nth").cast("long")))
    moves = cut_lineage(moves.join(places, (moves["_f"] == places["_pf"]) & (moves["_program"] == places["_pp"])).drop("_pf", "_pp"))
    start = targets.select(family, *(F.lit(0).cast("long").alias(c) for c in counts), F.array().cast("array<struct<nth:bigint,times:bigint>>").alias("_uses"))
    reached = frontier = cut_lineage(start)
    for _ in range(MAX_ROUNDS):
        if frontier.isEmpty():
            break
        ahead = frontier.join(moves, frontier[family] == moves["_f"]).join(limit.withColumnRenamed("_f", "_lf"), F.col(family) == F.col("_lf"))
        fits = F.lit(True)
        for c in counts:
            fits &= F.col(c) + F.col(f"_add_{c}") <= F.col(f"_limit_{c}")
        before = F.aggregate(F.filter("_uses", lambda u: u["nth"] == F.col("_nth")), F.lit(0).cast("long"), lambda n, u: n + u["times"])
        others = F.filter("_uses", lambda u: u["nth"] != F.col("_nth"))
        more = F.array_sort(F.concat(others, F.array(F.struct(F.col("_nth").alias("nth"), (before + F.col("_times")).alias("times")))))
        next_totals = ahead.where(fits).select(family, *((F.col(c) + F.col(f"_add_{c}")).alias(c) for c in counts), more.alias("_uses"))
        best = next_totals.groupBy(*key).agg(F.min_by("_uses", _preference("_uses")).alias("_uses"))
        known = reached.withColumnRenamed("_uses", "_known")
        compared = best.join(known, key, "left")
        frontier = cut_lineage(compared.where(F.col("_known").isNull() | (_preference("_uses") < _preference("_known"))).drop("_known"))
        reached = cut_lineage(reached.join(frontier, key, "left_anti").unionByName(frontier))
    else:
        raise RuntimeError(f"totals are still found after {MAX_ROUNDS} rounds")
    named = reached.select(*key, F.posexplode_outer("_uses").alias("_at", "_use")).join(
        places, (F.col(family) == F.col("_pf")) & (F.col("_use.nth") == F.col("_nth")), "left"
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("_use").isNotNull(), F.struct(F.col("_nth").alias("nth"), F.col("_pp").alias("program"), F.col("_use.times").alias("times")))))
    out = named.groupBy(*key).agg(listed.alias("_all"))
    return out.select(*key, F.transform("_all", lambda u: F.struct(u["program"].alias("program"), u["times"].alias("times"))).alias("uses"))


def _preference(column: str) -> Column:
    """Ways ordered by their use of the first program, then the second: the least is the one that is preferred."""
    return F.transform(column, lambda u: F.struct((-u["nth"]).alias("a"), u["times"].alias("b")))


def closest(reached: DataFrame, targets: DataFrame, family: str, counts: Sequence[str]) -> DataFrame:
    """Of each family the reached total that lacks least: ``family, reachable, n_totals``, what it lacks as ``gap_<count>``, and ``uses``."""
    limit = targets.select(F.col(family).alias("_f"), *(F.col(c).alias(f"_limit_{c}") for c in counts))
    lacks = {f"gap_{c}": F.col(f"_limit_{c}") - F.col(c) for c in counts}
    met = reached.join(limit, reached[family] == limit["_f"]).withColumns(lacks)
    total = sum((F.col(f"gap_{c}") for c in counts), F.lit(0))
    best = met.groupBy(family).agg(
        F.count(F.lit(1)).alias("n_totals"), F.min_by(F.struct(*lacks, "uses"), F.struct(total.alias("t"), *lacks)).alias("_best")
    )
    return best.select(family, (sum((F.col(f"_best.gap_{c}") for c in counts), F.lit(0)) == 0).alias("reachable"), "n_totals", *(F.col(f"_best.{g}") for g in lacks), "_best.uses")
