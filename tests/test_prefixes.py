"""Running digests, prompts held to them, sets held to each other, sources of timers and keys of schedules."""

import hashlib
import json

from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators import prefixes as P
from millrace.operators import rules as R


def digests(spark, rows):
    log = spark.createDataFrame(rows, "s long, n long, t string").repartition(4)
    return P.running_digests(log, "s", ["n"], F.col("t"))


def test_digests_equal_those_of_whole_prefixes(spark):
    rows = [(s, n, None if n == 3 else f"é{s}\n{n}") for s in (1, 2, None) for n in range(9)] + [(9, 5, "")]
    got = {(r["s"], r["n"]): (r["before"], r["upto"]) for r in digests(spark, rows).collect()}
    for s, n, _ in rows:
        lines = [t or "" for a, b, t in rows if a == s and b <= n]
        sha = lambda some: hashlib.sha256("\n".join(some).encode()).hexdigest()
        assert got[s, n] == (sha(lines[:-1]) if lines[:-1] else None, sha(lines))
    assert digests(spark, rows).limit(0).count() == 0


def test_each_leak_has_its_kind(spark):
    found = digests(spark, [(1, n, f"line {n}") for n in range(6)] + [(2, 0, "line 0"), (2, 1, "other")])
    upto = {(r["s"], r["n"]): r["upto"] for r in found.collect()}
    claims = [(1, 2, upto[1, 1]), (1, 3, upto[1, 4]), (1, 4, upto[1, 1]), (1, 5, "none"), (1, 9, upto[1, 5]), (2, 1, upto[1, 0]), (1, 0, None), (2, 0, upto[2, 0])]
    got = P.prompt_leaks(spark.createDataFrame(claims, "s long, n long, claimed string"), found, "s", "n").collect()
    # Two sessions that begin alike have the same digests, so a prompt of the one is the other's too.
    assert sorted(map(tuple, got)) == [(1, 3, "future", 4), (1, 4, "past", 1), (1, 5, "unknown", None), (1, 9, "no_row", 5), (2, 0, "future", 0)]


def test_set_differences(spark):
    left, right = (spark.createDataFrame([(k,) for k in keys], "k long") for keys in ([1, 2, 2, None], [1, 3, None, None] + [4] * 3))
    got = {r["k"]: r["problem"] for r in J.set_differences(left, right, ["k"], ("left", "right", "repeated")).collect()}
    assert got == {2: "left", 3: "right", 4: "right", None: "repeated"}


def test_sources_of_timers(spark):
    span = ["target_seq", "span_start"]
    actions = spark.createDataFrame([(1, 5, 2, 0), (1, 9, 3, 1), (1, 11, 3, 1), (2, 5, None, 0)], "session_id long, seq long, target_seq long, span_start int")
    timers = spark.createDataFrame([(1, "a", 2, 0), (1, "b", 3, 1), (1, "c", 2, 1), (2, "d", None, 0), (3, "e", 2, 0)], "session_id long, name string, target_seq long, span_start int")
    got = {r["name"]: (r["source_seq"], r["problem"]) for r in R.timer_sources(timers, actions, span).collect()}
    assert got == {"a": (5, "none"), "b": (None, "ambiguous"), "c": (None, "missing"), "d": (5, "none"), "e": (None, "missing")}


def test_schedule_key_is_that_of_the_canonical_json(spark):
    rows = spark.createDataFrame([("i_1", 5000, 'say "é"\n')], "i string, ms long, m string")
    body = json.dumps({"instruction_id": "i_1", "interval_ms": 5000, "message": 'say "é"\n'}, ensure_ascii=False, separators=(",", ":"))
    want = "sha256:" + hashlib.sha256(b"schedule-key-v1\0" + body.encode()).hexdigest()
    assert rows.select(R.schedule_key(F.col("i"), F.col("ms"), F.col("m"))).first()[0] == want
