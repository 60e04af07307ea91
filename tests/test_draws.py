"""Seeded draws against plain integers."""

import hashlib
import random

from pyspark.sql import functions as F

from millrace.functions import draws
from millrace.operators import synthesis


def fnv(text):
    h = 2_166_136_261
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2])) * 16_777_619) % 2**32
    return h


def sequence(state):
    while True:
        state = (state + 0x6D2B79F5) % 2**32
        m = ((state ^ state >> 15) * (state | 1)) % 2**32
        m ^= (m + (m ^ m >> 7) * (m | 61) % 2**32) % 2**32
        yield m ^ m >> 14


def test_generator_and_hash_equal_plain_integers(spark):
    seeds = ["a", "", "é\U0001f600", "seed-17", "2147483648"]
    rows = spark.createDataFrame([(s, i) for s in seeds for i in range(1, 40)], "s string, n long")
    got = {(r["s"], r["n"]): r["d"] for r in rows.select("s", "n", draws.draw32(draws.seed_of(F.col("s"), "x"), F.col("n")).alias("d")).collect()}
    for s in seeds:
        stream = sequence(fnv(f"string:{s}:x"))
        assert [got[s, i] for i in range(1, 40)] == [next(stream) for _ in range(1, 40)]


def test_digits_of_a_digest(spark):
    radices = [7, 16, 97, 1000, 2]
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(30)]
    got = [r["d"] for r in spark.createDataFrame([(i, d) for i, d in enumerate(digests)], "i long, h string").orderBy("i").select(draws.mixed_radix(F.col("h"), radices).alias("d")).collect()]
    want = []
    for d in digests:
        number, drawn = int(d, 16), []
        for r in radices:
            number, rest = divmod(number, r)
            drawn.append(rest)
        want.append(drawn)
    assert got == want


def test_intervals_add_up_and_keep_their_bounds(spark):
    rng = random.Random(1)
    rows = [(i, n, rng.randrange(n, n * 99)) for i, n in enumerate([1, 2, 7, 30, 30, 3] * 20)] + [(900, 3, 2), (901, 3, 298), (902, 0, 5), (903, 2, 198), (904, 4, 4)]
    bursts = spark.createDataFrame(rows, "b long, n long, total long")
    atoms = spark.createDataFrame([(float(v),) for v in (3, 20, 40.4, 250)], "ms double")
    made = lambda: synthesis.intervals_to_total(bursts, "b", F.col("b"), "n", "total", atoms, "ms", 100, 5)
    found = {}
    for r in made().collect():
        found.setdefault(r["b"], []).append(r["interval"])
    for b, n, total in rows:
        if n == 0:
            assert b not in found
        elif n <= total <= 99 * n:
            assert sum(found[b]) == total and len(found[b]) == n and all(1 <= v <= 99 for v in found[b])
        else:
            assert found[b] == [None] * n
    assert sorted(made().collect()) == sorted(made().collect())
    assert any(len(set(v)) > 3 for v in found.values())
