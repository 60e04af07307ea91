"""Joins over logs: as-of, range, positional, adjacent, bijection, provenance, closure.

As-of and range joins are written as one union and one window by session instead of a comparison join,
so their cost is a sort of both sides, whatever the number of matches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the ``carry`` columns of the latest right row at or before it; nulls where there is none."""
    taken = F.struct(*carry)
    kind = taken_type(right, carry)
    both = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast(kind).alias("_taken"))
    other = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_row"), taken.alias("_taken"))
    before = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = both.unionByName(other).withColumn("_latest", F.last("_taken", ignorenulls=True).over(before))
    return latest.where("_side = 1").select("_row.*", *(F.col(f"_latest.{c}").alias(f"as_of_{c}") for c in carry))


def as_of_many(left: DataFrame, key: str, left_at: str, tables: Mapping[str, DataFrame], right_at: str = "at") -> DataFrame:
    """Each left row with a struct for each table: the other columns of its latest row at or before the left one.

    All tables go through one sort of the key's rows.
    """
    rows = {name: F.struct(*(c for c in df.columns if c not in (key, right_at))) for name, df in tables.items()}
    kinds = {name: df.select(rows[name].alias("t")).schema["t"].dataType for name, df in tables.items()}
    nothing = {name: F.lit(None).cast(kind).alias(f"_{name}") for name, kind in kinds.items()}
    both = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), *nothing.values())
    for name, df in tables.items():
        here = {**nothing, name: rows[name].alias(f"_{name}")}
        both = both.unionByName(df.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_row"), *here.values()))
    before = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({name: F.last(f"_{name}", ignorenulls=True).over(before) for name in tables})
    return found.where("_side = 1").select("_row.*", *tables)


def taken_type(df: DataFrame, columns: Sequence[str]):
    return df.select(F.struct(*columns).alias("t")).schema["t"].dataType


def count_between(anchors: DataFrame, points: DataFrame, key: str, at: str) -> DataFrame:
    """Anchors with ``n_between``: the points after the anchor before and before this one; one running count, no range join."""
    both = anchors.select(key, at, F.lit(1).alias("_anchor")).unionByName(points.select(key, at, F.lit(0).alias("_anchor")))
    upto = Window.partitionBy(key).orderBy(at, F.desc("_anchor")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_points", F.sum(1 - F.col("_anchor")).over(upto)).where("_anchor = 1")
    order = Window.partitionBy(key).orderBy(at)
    between = F.col("_points") - F.lag("_points", 1, 0).over(order)
    return counted.select(key, at, between.alias("n_between"))


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, carry: Sequence[str]) -> DataFrame:
    """Points with the span of their key that contains them; spans of a key must not overlap, so the latest start decides."""
    found = as_of(points, spans, key, at, start, [end, *carry])
    return found.where(F.col(at) <= F.col(f"as_of_{end}")).drop(f"as_of_{end}")


def intervals(log: DataFrame, key: str, order: str, opens: Column, counted: Column) -> DataFrame:
    """Intervals from one opening row up to the next: key, first, next_first, n of ``counted`` rows inside."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.sum(opens.cast("long")).over(upto)
    inside = log.withColumn("_nth", nth).withColumn("_counted", counted).where("_nth > 0")
    each = inside.groupBy(key, "_nth").agg(F.min(order).alias("first"), F.count_if("_counted").alias("n"))
    return each.select(key, "first", F.lead("first").over(Window.partitionBy(key).orderBy("_nth")).alias("next_first"), "n")


def bijection(left: DataFrame, right: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Keys that break a one-to-one match, with the reason: missing on a side, repeated, or different in ``compared``."""
    def one_side(df: DataFrame, name: str) -> DataFrame:
        values = F.min(F.struct(*(compared or keys))).alias(f"_{name}")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), values)

    both = one_side(left, "left").join(one_side(right, "right"), list(keys), "full_outer")
    reason = (
        F.when(F.col("n_left").isNull(), "missing_left")
        .when(F.col("n_right").isNull(), "missing_right")
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated")
        .when(~F.col("_left").eqNullSafe(F.col("_right")), "different")
    )
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select(*keys, "reason")


def set_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], problems: tuple[str, str, str]) -> DataFrame:
    """Keys that keep two tables from being equal sets: only on the left, only on the right, or repeated on a side; nulls are keys.

    Both sides are counted before they meet, so a key repeated any number of times is one row of the join.
    """
    counted = [df.select(*keys, F.lit(s == 0).cast("long").alias("_l"), F.lit(s == 1).cast("long").alias("_r")) for s, df in enumerate((left, right))]
    both = counted[0].unionByName(counted[1]).groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    problem = F.when(F.col("_r") == 0, problems[0]).when(F.col("_l") == 0, problems[1]).when((F.col("_l") > 1) | (F.col("_r") > 1), problems[2])
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def zip_rows(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of equal place in each group side by side, all columns of both but the key once; places without a partner have nulls."""
    def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))

    return placed(left, left_order).join(placed(right, right_order), [key, "place"], "full_outer")


def pair_up(log: DataFrame, key: str, order: str, kind: str, first: str, second: str) -> DataFrame:
    """Rows of kind ``first`` with the row right after, and whether that is of kind ``second``: key, first_seq, second_seq, paired."""
    by = Window.partitionBy(key).orderBy(order)
    after = log.withColumn("_next_kind", F.lead(kind).over(by)).withColumn("second_seq", F.lead(order).over(by))
    paired = F.coalesce(F.col("_next_kind") == second, F.lit(False))
    return after.where(F.col(kind) == first).select(key, F.col(order).alias("first_seq"), "second_seq", paired.alias("paired"))


def preceded_by(log: DataFrame, key: str, order: str, here: Column, before: Column, same: Sequence[str]) -> DataFrame:
    """Rows where ``here`` holds, with ``source`` the order of the row right before if ``before`` holds there and ``same`` columns agree."""
    by = Window.partitionBy(key).orderBy(order)
    marked = log.withColumn("_before", before)
    agree = F.lag("_before").over(by)
    for c in same:
        agree = agree & F.lag(c).over(by).eqNullSafe(F.col(c))
    source = F.when(agree, F.lag(order).over(by))
    return marked.withColumn("source", source).where(here).drop("_before")


def with_default(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, default: object) -> DataFrame:
    """Left outer join of one column, with a default where the right side has no row."""
    values = right.select(*keys, F.col(column).alias("_value"))
    return left.join(values, list(keys), "left").withColumn(column, F.coalesce("_value", F.lit(default))).drop("_value")


def unmatched(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` whose columns, by name in ``on``, no row of ``right`` has: references that lead nowhere."""
    wanted = right.select(*(F.col(r).alias(left_name) for left_name, r in on.items())).distinct()
    return left.join(wanted, list(on), "left_anti")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by which two tables differ as multisets, with ``side`` and ``surplus``; empty if they are equal."""
    columns = left.columns
    sides = left.withColumn("_n", F.lit(1)).unionByName(right.select(*columns).withColumn("_n", F.lit(-1)))
    net = sides.groupBy(*columns).agg(F.sum("_n").alias("_net")).where("_net <> 0")
    side = F.when(F.col("_net") > 0, "left").otherwise("right")
    return net.select(*columns, side.alias("side"), F.abs("_net").alias("surplus"))


def complete_groups(rows: DataFrame, group: str, member: str, declared: str) -> DataFrame:
    """Rows of those groups whose members are exactly the ones that the array ``declared`` names."""
    present = rows.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("_present"), F.first(declared).alias("_declared"))
    whole = present.where(F.col("_present") == F.array_sort(F.array_distinct("_declared"))).select(group)
    return rows.join(whole, group, "left_semi")


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row of the highest version of each key."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*version)).alias("_row"))
    return best.select("_row.*")


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """``current`` overwritten and extended by ``new``, with ``collision`` where a fixed column would change."""
    columns = [c for c in current.columns if c not in keys]
    old_row, new_row = F.struct(*columns).alias("_old"), F.struct(*columns).alias("_new")
    both = current.select(*keys, old_row).join(new.select(*keys, new_row), list(keys), "full_outer")
    changed = F.lit(False)
    for c in fixed:
        changed = changed | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    collision = F.col("_old").isNotNull() & F.col("_new").isNotNull() & changed
    merged = F.when(F.col("_new").isNull() | collision, F.col("_old")).otherwise(F.col("_new"))
    return both.select(*keys, merged.alias("_m"), collision.alias("collision")).select(*keys, "_m.*", "collision")


def backfill(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose keys, nulls alike, it lacks."""
    have = target.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return target.unionByName(source.join(have, same, "left_anti"))


def token_key(text: Column) -> Column:
    """Words in lower case with one space between, before and after: containment at word boundaries becomes containment."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " "), F.lit(" "))
