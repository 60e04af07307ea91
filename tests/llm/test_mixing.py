import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M


def brute_fill(sizes, weights, share, epochs):
    """Clamp and share again, literally."""
    total = share * sum(sizes.values())
    clamped = {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        w = sum(weights[s] for s in free)
        want = {s: left * weights[s] / w for s in free} if w else {}
        over = [s for s in free if want[s] > epochs * sizes[s]]
        if not over:
            return clamped | want
        clamped |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [[10, 200, 50, 3000, 7], [1, 1, 1], [0, 5, 100, 40, 2, 900, 33, 8, 1]])
def test_water_fill_equals_clamping_loop(spark, sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    rows = [(f"s{i}", size, 1, float(w)) for i, (size, w) in enumerate(zip(sizes, weights, strict=True))]
    df = spark.createDataFrame(rows, "source string, source_size long, n_docs long, weight double")
    got = {r.source: r.target for r in M.water_fill(df, 1.5, 2.0).collect()}
    want = brute_fill({r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}, 1.5, 2.0)
    assert got == pytest.approx(want)


def plan(docs):
    measured = M.measure(docs)
    sources = M.plan_sources(measured)
    return M.repeat(measured, sources, M.choose(measured, sources))


def test_taken_words_come_near_targets(spark, documents):
    rows = [(i, "w " * (1 + i * 37 % 211), "en", ["hot", "b", "c", None][0 if i % 3 else i % 4]) for i in range(600)]
    out = plan(documents(rows)).toPandas()
    assert len(out) == 600 and out.repeats.between(0, 2).all()
    by = out.assign(taken=out["size"] * out.repeats).groupby("source", dropna=False).agg({"taken": "sum", "target": "first", "size": "sum", "source_size": "first"})
    assert (by["size"] == by.source_size).all()
    assert ((by.taken - by.target).abs() <= 3).all()
    again = plan(documents(rows[::-1])).toPandas()
    assert out.sort_values("id").repeats.tolist() == again.sort_values("id").repeats.tolist()


def test_salted_join_gives_the_same(spark, documents, monkeypatch):
    rows = [(i, "w " * (i % 50), "en", f"s{i % 4}" if i % 5 else None) for i in range(200)]
    first = sorted(map(tuple, plan(documents(rows)).collect()), key=str)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, plan(documents(rows)).collect()), key=str) == first


def test_odd_rows_and_empty_table(spark, odd_documents, documents):
    out = plan(odd_documents).toPandas()
    assert len(out) == odd_documents.count()
    assert out[out.id == 5].repeats.nunique() == 1
    assert (out[out["size"] == 0].repeats >= 0).all() and out.repeats.max() <= 2
    assert plan(documents([])).count() == 0


def test_cyclic_weights_put_null_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("B",), ("é",)], "source string")
    assert {r.source: r.weight for r in M.cyclic_weights(df).collect()} == {"B": 5.0, "b": 2.0, "é": 1.0, None: 5.0}


def test_word_count(spark):
    df = spark.createDataFrame([("a  b c\x0bd",), ("",), (None,), (" \n",)], "t string")
    assert [r[0] for r in df.select(M.word_count(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_the_query_mixes_as_its_contract_says(spark, documents, tmp_path):
    import random
    import re

    from millrace.llm.queries import queries

    rng = random.Random(4)
    names = [None, "b", "a", "Z", "é", "small"]
    weights = [3, 8, 8, 5, 9, 1]
    rows = [(i, " \t".join(["w"] * rng.randint(0, 90)) or None, "en", rng.choices(names, weights)[0]) for i in range(900)] + [(5, "x y", "en", "b"), (None, "p q r", "en", "a")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted((tuple(r[c] for c in ("doc_id", "source", "size", "source_size", "target", "taken")) for r in queries()["op8_source_mixing"](spark, str(tmp_path)).collect()), key=str)
    out = run()
    assert out == run() and len(out) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = brute_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    taken = {}
    for doc_id, source, size, source_size, target, took in out:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and took in (0, size, 2 * size)
        taken[source] = taken.get(source, 0) + took
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes)


def test_many_sources_are_numbered_across_ranges(spark):
    names = [f"s{i:04d}" for i in range(500)] + [None]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "source string").repartition(6)
    got = {r.source: r.weight for r in M.cyclic_weights(df).collect()}
    assert got == {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(names)}
