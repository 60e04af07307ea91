import random

import pytest

import corpus_pipeline as C
from millrace.llm import decontamination


def prose(rng, n):
    return " ".join(rng.choice(["alda", "berin", "corun", "dastel", "erimo", "fanu", "gol", "hista"]) + rng.choice("abcdefgh") for _ in range(n)).capitalize() + "."


ITEM = "Which old river of the western plain flows north through nine towns before it meets the sea? The slow Armandine."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = {i: "\n".join(prose(rng, 12) for _ in range(6)) for i in range(40)}
    rows = dict(clean)
    rows |= {100 + i: clean[3] for i in range(5)}  # exact copies
    rows |= {120: clean[4].upper().replace("É", "é")}  # equal but for case
    rows |= {130 + i: f"{prose(rng, 40)} {ITEM} {prose(rng, 40)}" for i in range(3)}  # leaks
    rows |= {140: "12345 !!! 777", 141: "", 142: None}  # no language
    boiler = "Shared closing line of every page here."
    rows |= {i: f"{rows[i]}\n{boiler}" for i in range(12)}
    docs = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean, rows, boiler


def test_each_stage_catches_its_cases_and_keeps_clean_documents(spark, planted):
    folder, clean, rows, boiler = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), docs.schema)
    assert set(rows) - set(seen["language"]) == {140, 141, 142}
    lines = seen["repeated_lines"]
    assert set(lines) == set(seen["language"])
    assert sum(boiler in (r.text or "") for r in lines.values()) == 1 and boiler in lines[0].text
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert all(lines[i].text.startswith(clean[i]) for i in clean)
    assert set(lines) - set(seen["near_copies"]) == {100, 101, 102, 103, 104, 120}
    assert set(seen["near_copies"]) - set(seen["benchmark_free"]) == {130, 131, 132}
    assert set(seen["benchmark_free"]) == set(clean)
    mix = C.STAGES[-1][1](spark, docs, folder).toPandas()
    sizes = docs.toPandas().assign(size=lambda d: d.text.str.split().str.len())
    assert set(columns) < set(mix.columns) and set(mix.doc_id) <= set(clean)
    taken = mix.text.str.split().str.len().groupby(mix.source).sum()
    target = mix.groupby("source")[C.TARGET].first()
    assert target.sum() == pytest.approx(1.5 * sizes["size"].sum())
    assert ((taken - target).abs() < 80).all() and mix.groupby("doc_id").size().max() <= 2


def test_run_equals_the_stages(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, docs.collect())) == sorted(map(str, C.run(spark, folder).collect()))


def test_odd_rows_and_empty_tables(spark, odd_documents, documents, tmp_path):
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_documents, documents([])):
        for name, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.collect()
    assert decontamination.leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
