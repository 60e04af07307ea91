import random

import corpus_pipeline as C

ITEM = "Which old river of the western plain flows north through nine towns before it meets the sea? The slow Armandine."


def test_language_and_benchmark_verdicts_are_of_each_text(spark, documents, tmp_path):
    rng = random.Random(8)
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = [" ".join(rng.choice(["alda", "berin", "corun", "dastel", "erimo"]) for _ in range(60)) for _ in range(30)]
    leaked = f"{prose[0]} {ITEM} {prose[1]}"
    rows = [(i, t) for i, t in enumerate(prose[:20])] + [(None, t) for t in prose[20:25]] + [(5, prose[26])]
    docs = documents(rows + [(None, "123 !!!"), (5, "77 ..."), (None, leaked), (6, leaked)])
    spoken = C.language(spark, docs, str(tmp_path))
    want = sorted(t for _, t in rows)
    assert sorted(r.text for r in spoken.collect()) == sorted([*want, leaked, leaked])
    assert sorted(r.text for r in C.benchmark_free(spark, spoken, str(tmp_path)).collect()) == want


def test_every_stage_keeps_and_drops_rows_and_not_ids(spark, documents, tmp_path):
    """Null and shared ids, repeated rows, edited copies, and columns named like those inside: the rows that leave each stage, listed."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = ["alda", "berin", "corun", "dastel", "erimo", "fanu", "gol", "hista", "irun", "jasel"]
    a, b, c, d, e, f = ("\n".join(" ".join(rng.choice(words) + rng.choice("abcdef") for _ in range(12)) for _ in range(6)) for _ in range(6))
    edited = d.rsplit(" ", 1)[0] + " changed"
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, f), (8, f), (9, edited), (10, d.upper()), (11, f"{a} {ITEM} {b}"), (None, f"{c} {ITEM}")]
    silent = [(None, "12 34"), (7, "..."), (12, None), (13, "")]
    extra = {n: F.lit("mine") for n in ("line_dedup", "text_hash", "fp", "node", "root", "key", "keeps", "size", "target", "source_hash", "hashes")}
    docs = documents([(i, t, "xx") for i, t in rows + silent]).withColumns(extra)

    def run():
        seen, now = {}, docs
        for name, stage in C.STAGES:
            now = stage(spark, now, str(tmp_path))
            got = now.collect()
            assert all(r.line_dedup == r.text_hash == r["keeps"] == "mine" for r in got), name
            seen[name] = sorted(((r.doc_id, r.text) for r in got), key=str)
            now = spark.createDataFrame(got, now.schema)
        return seen

    seen = run()
    assert seen["language"] == sorted(rows, key=str) == seen["repeated_lines"]
    unlike = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, f), (11, f"{a} {ITEM} {b}"), (None, f"{c} {ITEM}")]
    near = [r for r in unlike if r[1] != c and r[1] != f"{c} {ITEM}"] + [min([(None, c), (None, f"{c} {ITEM}")], key=lambda r: spark.range(1).select(F.xxhash64(F.lit(r[1]))).first()[0])]
    assert seen["near_copies"] in (sorted(unlike, key=str), sorted(near, key=str))
    assert seen["benchmark_free"] == [r for r in seen["near_copies"] if ITEM not in r[1]]
    assert set(seen["mixed"]) <= set(seen["benchmark_free"]) and run() == seen
