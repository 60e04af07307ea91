import math
import random

from millrace.llm import quantiles


def test_bounds_hold_the_exact_quantiles_within_a_bin(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() ** 3) for g in ("a", "b", None) for _ in range(400)] + [("c", 0.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in quantiles.ends(df.repartition(5), ["g"], "v", 0.01, 0.9).collect()}
    assert set(found) == {"a", "b", "c", None}
    for g, r in found.items():
        values = sorted(v for k, v in rows if k == g and v is not None)
        low, high = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.01, 0.9))
        assert r["n"] == len(values) and low - quantiles.BIN - 1e-9 <= r["low"] <= low + 1e-9 and high - 1e-9 <= r["high"] <= high + quantiles.BIN + 1e-9
    assert sorted(map(str, quantiles.ends(df.repartition(3), ["g"], "v", 0.01, 0.9).collect())) == sorted(map(str, found.values()))
