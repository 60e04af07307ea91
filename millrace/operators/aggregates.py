"""Rates, slices, spreads, mergeable metrics, percentiles, gates and group checks.

All aggregates here combine partially before the shuffle; slices at several levels come from one pass
with grouping sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import ranked


def rate(passed: Column, among: Column | None = None) -> Column:
    """Passed over total among the rows where ``among`` holds; null if there are none."""
    among = F.lit(True) if among is None else among
    total = F.count_if(among)
    return F.when(total > 0, F.count_if(among & passed) / total)


def slices(rows: DataFrame, levels: Sequence[Sequence[str]], keys: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """The measures for each grouping set in ``levels``; keys outside a set are null, ``level`` counts the keys of a set."""
    grouped = rows.groupingSets([[F.col(c) for c in level] for level in levels], *keys)
    depth = sum((1 - F.grouping(k).cast("int") for k in keys), F.lit(0))
    return grouped.agg(*measures, depth.alias("level"))


def spread(rows: DataFrame, outer: Sequence[str], inner: Sequence[str], passed: Column) -> DataFrame:
    """Per outer group the largest less the smallest of the inner groups' rates."""
    inner_rates = rows.groupBy(*outer, *inner).agg(rate(passed).alias("_rate"))
    return inner_rates.groupBy(*outer).agg((F.max("_rate") - F.min("_rate")).alias("spread"))


def counts_vector(rows: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """One column of counts for each kind, zero where absent."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def ratio_metrics(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge ``num, den, seen`` of each key: the sums, their ratio (null without a denominator), and whether anything was seen."""
    merged = parts.groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.bool_or("seen").alias("seen"))
    return merged.withColumn("value", F.when(F.col("den") != 0, F.col("num") / F.col("den")))


def summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of values and their exact, linearly interpolated p10, p50 and p90."""
    p = F.percentile(value, F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    found = rows.groupBy(*keys).agg(F.count(value).alias("n"), p.alias("_p"))
    return found.select(*keys, "n", *(F.col("_p")[i].alias(name) for i, name in enumerate(("p10", "p50", "p90"))))


#: Fixed values of the comparison: relative and absolute tolerances by kind of metric.
CONTINUOUS_PART, CONTINUOUS_MS, CONTINUOUS_MS_BELOW = 0.2, 75.0, 1000.0
CATEGORICAL_POINTS, RELATIVE_PART, SLACK = 0.05, 0.15, 1e-12


def compare_continuous(reference: DataFrame, synthetic: DataFrame, keys: Sequence[str], in_ms: Column) -> DataFrame:
    """Status of each key from two summary() tables: every percentile within a fifth, or 75 ms for short times."""
    right = synthetic.select(*keys, *(F.col(c).alias(f"syn_{c}") for c in ("n", "p10", "p50", "p90")))
    both = reference.join(right, list(keys), "left")
    ok = F.lit(True)
    for c in ("p10", "p50", "p90"):
        part = F.abs(c) * CONTINUOUS_PART
        allowed = F.when(in_ms & (F.abs(c) < CONTINUOUS_MS_BELOW), F.greatest(part, F.lit(CONTINUOUS_MS))).otherwise(part)
        ok = ok & (F.abs(F.col(f"syn_{c}") - F.col(c)) <= allowed + SLACK)
    status = F.when(F.col("n") == 0, "not_applicable").when(F.coalesce("syn_n", F.lit(0)) == 0, "fail").when(ok, "pass").otherwise("fail")
    return both.withColumn("status", status)


def compare_ratio(reference: Column, synthetic: Column, categorical: Column) -> Column:
    """Status of two ratios: within five points if categorical, else within 15 %, where nothing but nothing matches zero."""
    allowed = F.when(categorical, F.lit(CATEGORICAL_POINTS)).otherwise(F.abs(reference) * RELATIVE_PART)
    near = F.when(~categorical & (reference == 0), synthetic == 0).otherwise(F.abs(synthetic - reference) <= allowed + SLACK)
    return F.when(reference.isNull(), "not_applicable").when(synthetic.isNull(), "fail").when(near, "pass").otherwise("fail")


def verdicts(statuses: DataFrame, layer: Column) -> DataFrame:
    """Worst status of each layer among those that apply."""
    applied = statuses.where("status <> 'not_applicable'").groupBy(layer.alias("layer"))
    return applied.agg(F.when(F.count_if(F.col("status") == "fail") > 0, "fail").otherwise("pass").alias("verdict"))


def gates(values: DataFrame, rules: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``gate, value, passed`` for the columns of a one-row table held to (comparison, limit)."""
    rows = []
    for name, (op, limit) in rules.items():
        held = {">=": F.col(name) >= limit, "<=": F.col(name) <= limit, "=": F.col(name) == limit}[op]
        rows.append(F.struct(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), F.coalesce(held, F.lit(False)).alias("passed")))
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def crossing_owners(rows: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Values that more than one owner holds, with the sorted owners."""
    owners = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(owner)).alias("owners"))
    return owners.where(F.size("owners") > 1)


def against_target(rows: DataFrame, target: DataFrame, key: str, amount: Column) -> DataFrame:
    """Realised totals beside target totals; either may be absent and counts as 0."""
    realised = rows.groupBy(key).agg(F.sum(amount).alias("realised"))
    both = realised.join(target, key, "full_outer").fillna(0, ["realised", "target"])
    return both.select(key, "realised", "target", (F.col("target") - F.col("realised")).alias("missing"))


def yield_shapes(units: DataFrame, unit: str, vector: Sequence[str], programs: str) -> DataFrame:
    """Units of equal action vector together: how many, the least of them, and the sum of their programs."""
    return units.groupBy(F.array(*vector).alias("vector")).agg(
        F.count(F.lit(1)).alias("n_units"), F.min(unit).alias("first_unit"), F.sum(programs).alias("programs")
    )


def queue(rows: DataFrame, key: str, rarity: str, item: str) -> DataFrame:
    """Groups with their number of rows, highest rarity and sorted items, ranked by rarity and then key."""
    grouped = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(rarity).alias("rarity"), F.array_sort(F.collect_list(item)).alias("items")
    )
    return ranked(grouped, "rarity", [F.col(key)], "place_in_rarity")


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: the counterexamples of uniqueness."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
