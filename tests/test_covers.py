"""Covers and exact totals against plain Python, one choice after the other."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import covers as C
from millrace.operators.ranking import hash_rank


def plain_cover(labels):
    rank = lambda i: hashlib.sha256(f"d\0{i}".encode()).hexdigest()
    left, taken = set().union(*labels.values()) if labels else set(), []
    while left:
        best = min((i for i in labels if i not in taken), key=lambda i: (-len(labels[i] & left), rank(i)))
        taken.append(best)
        left -= labels[best]
    return set(taken), sorted(labels, key=rank)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_take_what_one_choice_after_the_other_takes(spark, seed):
    rng = random.Random(seed)
    labels = {i: {f"l{rng.randrange(25) ** 2 // 25}" for _ in range(rng.randrange(1, 6))} | ({"hot"} if i % 3 else set()) for i in range(120)}
    df = spark.createDataFrame([(i, x) for i, found in labels.items() for x in found] * 2, "item long, label string").repartition(5)
    want, order = plain_cover(labels)
    rank = hash_rank(F.col("item"), "d")
    assert {r["item"] for r in C.greedy_cover(df, "item", "label", rank).collect()} == want
    got = C.cover_and_fill(df, "item", "label", rank, 0.1, 0.15, 0.9).collect()
    fill = [i for i in order if i not in want][: max(18 - len(want), 0)]
    assert {r["item"] for r in got} == want | set(fill) and {r["item"] for r in got if r["in_cover"]} == want


def test_cover_that_does_not_fit_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(10)], "item long, label string")
    with pytest.raises(ValueError, match="10 items cover"):
        C.cover_and_fill(df, "item", "label", hash_rank(F.col("item"), "d"), 0.1, 0.15, 0.2)
    assert C.greedy_cover(df.limit(0), "item", "label", F.col("item")).count() == 0


def plain_reach(programs, target):
    """All totals within the target, each with its first way by (uses of the first program, of the second, ...)."""
    ranges = [range(1 + min((t // v for v, t in zip(p, target) if v), default=0)) for p in programs]
    out = {}
    for uses in itertools.product(*ranges):
        total = tuple(sum(n * p[c] for n, p in zip(uses, programs)) for c in range(len(target)))
        if all(v <= t for v, t in zip(total, target)):
            out.setdefault(total, uses)
    return out


def test_totals_and_ways_equal_the_plain_program(spark):
    rng = random.Random(5)
    families = {f: ([tuple(rng.randrange(4) for _ in range(3)) for _ in range(rng.randrange(1, 5))], tuple(rng.randrange(4, 12) for _ in range(3))) for f in "abcd"}
    families["e"] = ([(0, 0, 0), (9, 0, 0)], (5, 5, 5))
    families["f"] = ([(1, 0, 0), (1, 0, 0)], (13, 0, 0))
    rows = [(f, i, *p) for f, (programs, _) in families.items() for i, p in enumerate(programs)]
    names = ["x", "y", "z"]
    programs = spark.createDataFrame(rows, "family string, program long, x long, y long, z long")
    targets = spark.createDataFrame([(f, *t) for f, (_, t) in families.items()], "family string, x long, y long, z long")
    reached = C.exact_reach(programs, targets, "family", "program", names)
    got = {(r["family"], r["x"], r["y"], r["z"]): [tuple(u) for u in r["uses"]] for r in reached.collect()}
    want = {(f, *total): [(i, n) for i, n in enumerate(uses) if n] for f, (ps, target) in families.items() for total, uses in plain_reach(ps, target).items()}
    assert got == want
    best = {r["family"]: r for r in C.closest(reached, targets, "family", names).collect()}
    for f, (ps, target) in families.items():
        lacks = min((tuple(t - v for v, t in zip(total, target)) for total in plain_reach(ps, target)), key=lambda g: (sum(g), g))
        assert tuple(best[f][f"gap_{c}"] for c in names) == lacks and best[f]["reachable"] == (sum(lacks) == 0)


def test_share_of_each_stratum_equals_sorting(spark):
    from millrace.operators import ranking

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"s{i % 40}"])) for i in range(900)] + [(5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "i long, s string").repartition(4)
    got = sorted((r["i"], r["s"] or "") for r in ranking.stratified_share(df, "s", ranking.hash_rank(F.col("i"), "d"), 10).collect())
    want = []
    for s in {s for _, s in rows}:
        inside = sorted((hashlib.sha256(f"d\0{i}".encode()).hexdigest(), i) for i, t in rows if t == s)
        want += [(i, s or "") for _, i in inside[: -(-len(inside) * 10 // 100)]]
    assert got == sorted(want)
    assert ranking.stratified_share(df.limit(0), "s", ranking.hash_rank(F.col("i"), "d"), 10).count() == 0
