"""Ordered operators over ranges against plain loops, one session far larger than a range."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import spread as P


def plain_frames(rows, throttle, pause):
    """rows of (at, hint) of one session in order -> frames."""
    out = [("active", -1, 0, 0, rows[0][0], None)]
    opened, window, hint = None, -1, None
    for i, (at, h) in enumerate(rows):
        if i:
            if opened is None:
                opened, window, hint = i, window + 1, None
            hint = h if h is not None else hint
        after = rows[i + 1][0] if i + 1 < len(rows) else None
        rests = after is None or after - at >= pause
        if opened is not None:
            ends = min(rows[opened][0] + throttle, at + pause)
            if rests or after >= rows[opened][0] + throttle:
                out.append(("active", window, opened, i, ends, hint))
                opened = None
        if rests:
            out.append(("paused", window, i, i, at + pause, None))
    return out


def logs(seed, sizes, step):
    rng = random.Random(seed)
    rows = []
    for session, n in sizes.items():
        at = 0
        for _ in range(n):
            at += rng.choice([0, 1, 3, step, step * 4])
            rows.append((session, at, rng.choice([None, None, rng.randrange(99)])))
    return rows


@pytest.mark.parametrize(("throttle", "pause"), [(10, 40), (30, 12)])
def test_sampler_equals_a_loop(spark, throttle, pause):
    rows = logs(1, {1: 400, 2: 1, None: 37, 4: 2}, 9)
    by_session = {}
    for i, (s, at, h) in enumerate(rows):
        by_session.setdefault(s, []).append((at, h))
    log = spark.createDataFrame([(s, at, h, i) for i, (s, at, h) in enumerate(rows)], "session_id long, at long, hint long, nth long").repartition(6)
    got = P.sampled(log, "session_id", ["at", "nth"], "at", throttle, pause, "hint")
    want = [(s, *f) for s, found in by_session.items() for f in plain_frames(found, throttle, pause)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_packing_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice([1, 5, 40, 300]), rng.randrange(9), 1) for s, n in (("a", 300), (None, 40), ("c", 1)) for i in range(n)]
    caps = {"size": 100, "weight": 30, "one": 6}
    want, state = [], {}
    for s, i, *costs in rows:
        shard, held = state.get(s, (0, (0, 0, 0)))
        new = tuple(h + c for h, c in zip(held, costs))
        if held[2] and any(n > cap for n, cap in zip(new, caps.values())):
            shard, new = shard + 1, tuple(costs)
        state[s] = shard, new
        want.append((s, i, shard, *new))
    df = spark.createDataFrame(rows, "source string, item long, size long, weight long, one long").repartition(5)
    got = P.packed(df, "source", ["item"], caps).select("source", "item", "shard", "held_size", "held_weight", "held_one")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_long_session_lies_over_several_tasks(spark):
    n = 60_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one task's
    log = spark.range(n).select(F.lit(7).cast("long").alias("session_id"), (F.col("id") * 3).alias("at"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("hint"))
    try:
        placed = P.number(log, "session_id", ["at"])
        sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
        assert len(sizes) > 2 and max(sizes) < n / 2
        frames = P.sampled(log, "session_id", ["at"], "at", 100, 1000, "hint")
        found = {r["activity"]: r for r in frames.groupBy("activity").agg(F.count("*").alias("n"), F.max("window").alias("last"), F.max("last_seq").alias("seq")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # A window of 100 holds the 34 rows that begin within it.
    assert found["active"]["n"] == 1 + -(-(n - 1) // 34) and found["paused"]["n"] == 1 and found["active"]["seq"] == n - 1


def test_empty_logs(spark):
    empty = spark.createDataFrame([], "session_id long, at long, hint long")
    assert P.sampled(empty, "session_id", ["at"], "at", 5, 9, "hint").count() == 0
    assert P.packed(empty, "session_id", ["at"], {"at": 9}).count() == 0
