"""Cases that the tables do not hold, and operators without SQL against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import canonical, edits, hashing, text, utf16
from millrace.operators import corpus, harness, joins, ranking, rules, sequence, state
from millrace.operators import aggregates as A
from millrace.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gap_of_exactly_the_threshold_starts_a_burst(spark):
    log = spark.createDataFrame([(1, 0), (1, 10), (1, 19)], "s long, t long")
    assert [r.burst for r in sequence.burst(log, "s", ["t"], "t", 10).orderBy("t").collect()] == [1, 2, 2]


def test_last_run_is_flushed(spark):
    log = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, False, True, True])], "s long, t long, b boolean")
    assert rows(sequence.runs(log, "s", ["t"], F.col("b")), "run") == [(1, 1, 1), (1, 2, 2)]


def test_propagation_ends_where_the_text_changes(spark):
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate("aabba")], "s long, t long, x string")
    done = sequence.propagate(log, "s", ["t"], "x", F.col("t") == 0).orderBy("t").collect()
    assert [r.handled for r in done] == [True, True, False, False, False]


def test_tail_stops_at_the_first_overflow(spark):
    log = spark.createDataFrame([(1, 0, 1), (1, 1, 50), (1, 2, 5)], "s long, t long, c long")
    assert [r.t for r in sequence.newest_within(log, "s", ["t"], F.col("c"), 10).collect()] == [2]


def test_as_of_with_ties_and_nothing_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, at long")
    right = spark.createDataFrame([(1, 5, "x"), (1, 3, "y")], "k long, at2 long, v string")
    assert rows(joins.as_of(left, right, "k", "at", "at2", ["v"]), "k", "at") == [(1, 1, None), (1, 5, "x"), (2, 9, None)]


def test_bijection_reasons(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (5, "e")], "id long, v string")
    b = spark.createDataFrame([(1, "a"), (2, "z"), (3, "c"), (4, "d")], "id long, v string")
    assert rows(joins.bijection(a, b, ["id"], ["v"]), "id") == [(2, "different"), (3, "repeated"), (4, "missing_left"), (5, "missing_right")]


def test_tolerance_edges(spark):
    cases = [(100.0, 120.0, False, "pass"), (100.0, 120.1, False, "fail"), (100.0, 175.0, True, "pass"), (1000.0, 1200.1, True, "fail"), (0.0, 0.0, False, "pass")]
    for ref, syn, ms, want in cases:
        one, two = (spark.createDataFrame([("m", 1, v, v, v)], "metric string, n long, p10 double, p50 double, p90 double") for v in (ref, syn))
        assert A.compare_continuous(one, two, ["metric"], F.lit(ms)).first().status == want
    ratios = spark.createDataFrame([(0.5, 0.55, True, "pass"), (0.5, 0.551, True, "fail"), (0.0, 0.01, False, "fail"), (0.0, 0.0, False, "pass"), (1.0, 1.15, False, "pass"), (None, 1.0, False, "not_applicable"), (1.0, None, True, "fail")], "r double, s double, c boolean, want string")
    done = ratios.withColumn("got", A.compare_ratio(F.col("r"), F.col("s"), F.col("c"))).collect()
    assert all(r.got == r.want for r in done)


def test_coalescing_keeps_newest_and_merges_missed(spark):
    log = spark.createDataFrame([(1, 0, "view", 0, 0), (1, 1, "click", 7, 2), (1, 2, "other", 0, 0), (1, 3, "view", 0, 0), (1, 4, "click", 7, 1), (1, 5, "click", 8, 0), (1, 6, "purchase", 0, 0), (1, 7, "view", 0, 0)], "s long, seq long, kind string, timer long, missed long")
    got = rows(state.coalesce_pending(log, "s", "seq", "kind", "purchase", "view", "click", "timer", "missed"), "seq")
    assert got == [(1, 0, "other", 2, None), (1, 0, "view", 3, None), (1, 0, "click", 4, 4), (1, 0, "click", 5, 0), (1, 1, "view", 7, None)]


def test_fixed_rate_claims(spark):
    timers = spark.createDataFrame([(1, 0, 100, 0), (2, 0, 100, 3), (3, 50, 100, 0)], "id long, anchor long, every long, n long")
    got = rows(state.claim_timers(timers, F.lit(350), "anchor", "every", "n").select("id", "fires", "missed", "late_ms", "next_due"), "id")
    assert got == [(1, 3, 2, 50, 400), (3, 3, 2, 0, 450)]


def test_rollover_counts_the_checkpoint_after_a_reset(spark):
    log = spark.createDataFrame([(1, i, 40) for i in range(6)], "s long, seq long, size long")
    got = rows(state.fold(log, "s", ["seq"], ["seq", "size"], state.rollover(100, 30), "s long, seq long, segment long, held long"), "seq")
    assert [g[2:] for g in got] == [(0, 40), (0, 80), (0, 120), (1, 70), (1, 110), (2, 70)]


def test_packing_respects_each_limit():
    step, held = state.pack(2, 100, 50), {}
    assert [step(held, row)[1] for row in [("a", 10, 1), ("b", 10, 1), ("c", 10, 1), ("d", 95, 1), ("e", 1, 50)]] == [0, 0, 1, 2, 3]


def test_span_is_followed_only_through_unique_context():
    def run(*texts):
        step, held = state.follow_span(), {}
        return [step(held, (i, t))[1:] for i, t in enumerate(texts)]

    assert run("mark this", "please mark this") == [(0, 4), (7, 11)]
    assert run("mark this", "mark this mark this")[1] == (None, None)
    assert run("mark this", "gone", "mark this")[1:] == [(None, None)] * 2


def test_edit_kinds():
    cases = [("", "a", "insert"), ("ab", "b", "delete"), ("abc", "axc", "replace"), ("a", "a", "none"), ("aa", "aaa", "insert"), ("x\U0001f600", "x", "delete")]
    assert [edits.changed_kind(a, b) for a, b, _ in cases] == [k for *_, k in cases]


def test_canonical_json_rules():
    assert canonical.canonical('{"b": 1, "a": [true, null]}') == '{"a":[true,null],"b":1}'
    assert canonical.canonical('{"\U0001f600":1,"￿":2}') == '{"\U0001f600":1,"￿":2}'
    for bad in ['{"a":1,"a":2}', "1.5", "NaN", "{", str(2**53), "[" * 20 + "]" * 20, '"' + "x" * 5000 + '"']:
        assert canonical.canonical(bad) is None


def test_utf16_slices(spark):
    df = spark.createDataFrame([("a\U0001f600bc",)], "t string")
    t = F.col("t")
    got = df.select(utf16.units(t), utf16.piece(t, F.lit(1), F.lit(4)), utf16.piece(t, F.lit(2), F.lit(4)), utf16.point_index(t, F.lit(3)), utf16.point_index(t, F.lit(2))).first()
    assert tuple(got) == (5, "\U0001f600b", None, 2, None)


def test_timer_grammar(spark):
    texts = ["Remind me every one minute to stretch.", "Set another reminder every ninety-nine seconds to look up.", "Remind me every one minutes to x.", "Remind me every zero seconds to x.", "remind me every two seconds to x."]
    got = text.parse_timer(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [tuple(g)[1:] for g in got] == [(60_000, "stretch", False), (99_000, "look up", True)] + [(None,) * 3] * 3


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    bases = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randint(0, 30)) for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(48):
        words = bases[i % 6].split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words), f"s{i // 6 % 3}"))  # each base in every split
    docs += [(100, "short", "s0"), (101, None, "s1"), (102, docs[0][1], "s2")]

    def grams(t):
        t = " ".join(t.lower().split())
        return t, {t[i : i + 5] for i in range(len(t) - 4)}

    links = {}
    for i, a, s in docs:
        for j, b, z in docs:
            if i != j and s != z and a and b and len(a) >= 80 and len(b) >= 80:
                (ta, ga), (tb, gb) = grams(a), grams(b)
                if ta != tb and len(ga & gb) / len(ga | gb) >= 0.82:
                    links.setdefault(i, {}).setdefault(tb, []).append(j)
    df = spark.createDataFrame(docs, "doc long, t string, split string")
    got = {r.doc: r.n_links for r in corpus.near_duplicates(df, "doc", "t", "split").collect()}
    assert got == {i: len(texts) for i, texts in links.items()} and got


def test_near_duplicates_in_tiles_of_any_size(spark, monkeypatch):
    """Texts of all sizes out of few words share most n-grams, so only comparing pairs by bits, in bounded tiles, tells them apart."""
    rng = random.Random(4)
    docs = []
    for i in range(60):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(14, 90))]
        docs += [(4 * i, " ".join(words), "a"), (4 * i + 1, " ".join(words[: rng.randint(-8, -1)]), "b"), (4 * i + 2, " ".join(words[::-1]), "b"), (4 * i + 3, " ".join(words), rng.choice("ab"))]
    grams = {t: {t[i : i + 5] for i in range(len(t) - 4)} for _, t, _ in docs if len(t) >= 80}
    splits = {t: {s for _, u, s in docs if u == t} for t in grams}
    least = {t: min(i for i, u, _ in docs if u == t) for t in grams}
    alike = {t: [u for u in grams if u != t and len(grams[t] & grams[u]) / len(grams[t] | grams[u]) >= 0.82] for t in grams}
    want = {}
    for i, t, s in docs:
        linked = [least[u] for u in alike.get(t, ()) if splits[u] - {s}]
        if linked:
            want[i] = (len(linked), min(linked))
    df = spark.createDataFrame(docs, "doc long, t string, split string")
    for rows_, chars in ((corpus.TILE_ROWS, corpus.TILE_CHARS), (7, 10**9)):
        monkeypatch.setattr(corpus, "TILE_ROWS", rows_)
        monkeypatch.setattr(corpus, "TILE_CHARS", chars)
        got = {r.doc: (r.n_links, r.least_linked) for r in corpus.near_duplicates(df, "doc", "t", "split").collect()}
        assert got == want and got
    assert corpus.near_duplicates(df.where("doc < 0"), "doc", "t", "split").count() == 0


def _rows_shuffled(spark):
    context = spark.sparkContext
    gateway, none = context._gateway, context._jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_near_duplicates_shuffle_no_row_for_each_block_or_pair(spark, monkeypatch):
    """Texts meet in many small blocks, and one group of near copies is larger than a tile; null splits, splits in common and an id given twice."""
    rng = random.Random(6)
    made = lambda: [f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.randint(0, 999)}" for _ in range(24)]
    base = made()
    texts_ = [" ".join(made()) for _ in range(240)] + [" ".join([*base, f"x{i:03}"]) for i in range(120)]
    docs = [(i, t, rng.choice("abc")) for i, t in enumerate(texts_)]
    docs += [(400, texts_[250], None), (401, texts_[251], "a"), (402, " ".join([*base, "y001"]), None), (403, " ".join([*base, "y002"]), "c"), (403, " ".join([*base, "y002"]), "c")]
    grams = {t: {t[i : i + 5] for i in range(len(t) - 4)} for _, t, _ in docs}
    splits = {t: {s for _, u, s in docs if u == t and s} for t in grams}
    least = {t: min(i for i, u, _ in docs if u == t) for t in grams}
    alike = {t: [u for u in grams if u != t and len(grams[t] & grams[u]) / len(grams[t] | grams[u]) >= 0.82] for t in grams}
    want = {}
    for i, t, s in docs:
        linked = [least[u] for u in alike[t] if s and splits[u] - {s}]
        if linked:
            want[i] = (want.get(i, (0,))[0] + len(linked), min(linked))
    for name, value in (("ROUND_BYTES", 2_000), ("TILE_ROWS", 20), ("TILE_CHARS", 10**9), ("PAIRS", 50)):
        monkeypatch.setattr(corpus, name, value, raising=False)
    before = _rows_shuffled(spark)
    df = spark.createDataFrame(docs, "doc long, t string, split string")
    got = {r.doc: (r.n_links, r.least_linked) for r in corpus.near_duplicates(df, "doc", "t", "split").collect()}
    assert got == want and len(got) > 100
    moved = sum(rows for stage, rows in _rows_shuffled(spark).items() if stage not in before)
    assert moved < 30 * len(docs), moved


def test_overused_by_hashes_in_any_number_of_parts(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i // 2 if i < 20 else i, [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))] if i % 9 else None) for i in range(200)]
    found = {}
    for i, words in docs:
        for w in words or ():
            found.setdefault(w, set()).add(i)
    df = spark.createDataFrame(docs, "doc long, w array<string>")
    for parts in (corpus.PARTS, 4):
        monkeypatch.setattr(corpus, "PARTS", parts)
        got = {r.gram: r.n_docs for r in corpus.overused(df, "doc", F.col("w"), 22).collect()}
        assert got == {w: len(ids) for w, ids in found.items() if len(ids) > 22} and got


def test_top_cosine_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)] if i else None) for i in range(60)], "vec_id long, embedding array<float>").repartition(4)
    one = rows(corpus.top_cosine(df, F.col("vec_id") % 5 == 0, 4), "query_id", "place")
    monkeypatch.setattr(corpus, "QUERY_BLOCK", 3)
    many = rows(corpus.top_cosine(df, F.col("vec_id") % 5 == 0, 4), "query_id", "place")
    assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) == 44


def test_overuse_and_phrases(spark):
    df = spark.createDataFrame([(1, "A red fox ran"), (2, "The red fox, ran!"), (3, "redfox ran"), (4, None)], "doc long, t string")
    phrases = spark.createDataFrame([(7, "red fox ran"), (8, ""), (9, "fox")], "item long, p string")
    assert rows(corpus.containing_phrases(df, phrases, "doc", "t", "item", "p"), "doc", "item") == [(1, 7), (1, 9), (2, 7), (2, 9)]


def test_sequences_and_grades(spark):
    a = spark.createDataFrame([(1, 0, 0, "x"), (1, 1, 10, "y")], "k long, o long, at long, v string")
    b = spark.createDataFrame([(1, 0, 5, "x"), (1, 1, 30, "z"), (1, 2, 40, "w")], "k long, o long, at long, v string")
    assert rows(harness.compare_sequences(a, b, "k", "o", "at", 10, ["v"]), "place", "field") == [(1, 2, "at"), (1, 2, "v"), (1, 3, "missing")]
    graded = harness.grade(spark.createDataFrame([(True, None, True)], "a boolean, b boolean, c boolean"), {x: F.col(x) for x in "abc"}).first()
    assert graded.failed_at == "b" and graded.a and not graded.c


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b\nc")], "id long, kind string")
    files.write_lines(df, F.to_json(F.struct("id", "kind")), f"{tmp_path}/log")
    good, bad = files.read_jsonl(spark, f"{tmp_path}/log", "id long, kind string")
    assert rows(good, "id") == [(1, "a"), (2, "b\nc")] and bad.count() == 0
    assert files.read_segments(spark, f"{tmp_path}/log/*.txt").count() == 2
    (tmp_path / "one.bin").write_bytes(b"content")
    images = spark.read.format("binaryFile").load(f"{tmp_path}/one.bin").select("path", "content")
    files.store_artifacts(images.union(images), f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 1


def test_empty_tables(spark):
    log = spark.createDataFrame([], "s long, t long, kind string")
    assert sequence.burst(log, "s", ["t"], "t", 5).count() == 0
    assert sequence.transitions(log, "s", ["t"], "kind").count() == 0
    assert joins.latest(log, ["s"], ["t"]).count() == 0
    assert corpus.top_cosine(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), 3).count() == 0
    with pytest.raises(KeyError):
        A.gates(log, {"n": ("!", 1)})


def test_folds_keep_64_bit_keys_and_nulls(spark):
    log = spark.createDataFrame([(2**53 + 1, 0, 40), (2**53 + 1, 1, 80), (None, 0, 5), (None, 1, 6), (2**53, 0, 7)], "s long, seq long, size long")
    got = state.fold(log, "s", ["seq"], ["seq", "size"], state.rollover(1000, 30), "s long, seq long, segment long, held long").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2**53 + 1, 0, 0, 40), (2**53 + 1, 1, 0, 120), (None, 0, 0, 5), (None, 1, 0, 11), (2**53, 0, 0, 7)], key=str)


def test_reduced_state_row_by_row(spark):
    log = spark.createDataFrame([(1, 0, "view", 9), (1, 1, "signup", 3), (1, 2, "signup", 19), (1, 3, "click", 1), (1, 4, "click", 1), (1, 5, "purchase", 3), (1, 6, "error", 0), (1, 7, "view", 2)], "s long, seq long, kind string, k long")
    got = state.fold(log, "s", ["seq"], ["seq", "kind", "k"], state.reduce_visible, "s long, seq long, view long, n_timers long, pending long").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 9, 0, 0), (1, 9, 1, 0), (2, 9, 1, 0), (3, 9, 1, 1), (4, 9, 1, 2), (5, 9, 0, 2), (6, 9, 0, 0), (7, 2, 0, 0)]


def test_top_cosine_keeps_64_bit_ids(spark):
    df = spark.createDataFrame([(2**53 + 2 * i + 1, [1.0, i / 7]) for i in range(9)], "vec_id long, embedding array<double>").repartition(3)
    got = corpus.top_cosine(df, F.col("vec_id") == 2**53 + 1, 3).orderBy("place").collect()
    assert [r.vec_id - 2**53 for r in got] == [3, 5, 7] and {r.query_id for r in got} == {2**53 + 1}


def test_canonical_depth_counts_containers_alone(spark):
    assert canonical.canonical("[" * 8 + "1" + "]" * 8) is not None and canonical.canonical("[" * 9 + "]" * 9) is None
    assert canonical.canonical('{"a":' * 8 + "null" + "}" * 8) is not None and canonical.canonical('{"a":' * 9 + "1" + "}" * 9) is None
    df = spark.createDataFrame([('{"b": [1, {"a": "x"}], "a": null}',), ("{oops",), (None,)], "j string")
    assert [r[0] for r in df.select(canonical.scalars("j")).collect()] == [["1", '"x"', "null"], None, []]


def test_keys_of_null_parts_do_not_collide(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "", "b")], "x string, y string, z string")
    got = [tuple(r) for r in df.select(hashing.joined_key([F.col("x"), F.col("y"), F.col("z")]), hashing.joined_key([F.col("x"), F.col("z")])).collect()]
    assert got[0][0] is None and got[1][0] != got[1][1]


def test_places_in_large_groups_equal_a_sort(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o long, i long").repartition(7)
    got = {r.i: r.place for r in ranking.ranked(df, "g", [F.col("o"), F.col("i")], "place").collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((o, i) for x, o, i in data if x == g))}
    assert got == want


def test_phrases_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, "A red fox ran"), (2, "The red fox, ran!"), (3, "redfox ran"), (4, None)], "doc long, t string")
    phrases = spark.createDataFrame([(7, "red fox ran"), (8, ""), (9, "fox"), (10, "The Red Fox ran")], "item long, p string")
    small = rows(corpus.containing_phrases(df, phrases, "doc", "t", "item", "p"), "doc", "item")
    monkeypatch.setattr(corpus, "BROADCAST_PHRASE_CHARS", 0)
    assert rows(corpus.containing_phrases(df, phrases, "doc", "t", "item", "p"), "doc", "item") == small == [(1, 7), (1, 9), (2, 7), (2, 9), (2, 10)]


def test_normalized_text_and_revision_ratio(spark):
    df = spark.createDataFrame([("  Straße\n ﬁx\u3000É ", "a b c d", "a x c d"), (None, None, "a"), ("", "", "")], "t string, a string, b string")
    got = [tuple(r) for r in df.select(text.normalized("t"), edits.matching_ratio("a", "b")).collect()]
    assert got == [("strasse fix é", 0.75), (None, 0.0), ("", 1.0)]


def test_fixed_patterns(spark):
    cases = {
        text.DIRECTIVE: (["stop timer", "Cancel  the timer", "every day"], ["bookmarks", "stop that timer"]),
        text.NEGATION: (["don't go", "Do not", "NEVER"], ["nothing", "knot"]),
        text.UNSUPPORTED_TIMER: (["try at 5", "three times", "Once"], ["at five", "untilted"]),
        text.META: (["a held-out part", "Public  replay", "test set"], ["scoreboard", "held outside"]),
        text.ADDITIONAL: (["Set up another egg timer", "add an additional slow-cooker kitchen reminder"], ["set another alarm", "another timer"]),
    }
    for pattern, (hits, misses) in cases.items():
        df = spark.createDataFrame([(t,) for t in hits + misses], "t string")
        assert [r[0] for r in df.select(F.col("t").rlike(pattern)).collect()] == [True] * len(hits) + [False] * len(misses), pattern


def test_patterns_match_as_in_sql(spark):
    import duckdb

    texts = ["éno x", "nó", "não", "ſtop timer", "looK up", "look\x0bup", "marK", "every ſ", "every\fday", "İ not ıs", "xſ not", "don’té", "do\x0bnot", "teſt set", "aſk me", "why\rso?", "is it\x85so?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (text.DIRECTIVE, text.NEGATION, text.META, text.QUESTION):
        got = [r[0] for r in df.select(text.matches(F.col("t"), pattern)).collect()]
        assert got == [duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts], pattern


def test_oldest_open_item_by_brute_force(spark):
    rng = random.Random(5)
    items = []
    for s in range(6):
        for seq in range(0, 40, 2):
            items.append((s, seq, rng.choice([None, *range(seq + 1, 41, 2)])))
    df = spark.createDataFrame(items, "session_id long, seq long, done_at long").withColumn("item", F.col("seq"))
    spans = [tuple(r) for r in rules.oldest_open(df, ["item"]).collect()]
    for s in range(6):
        for at in range(1, 42, 2):
            is_open = [seq for x, seq, done in items if x == s and seq < at and (done is None or done >= at)]
            assert [item for x, start, end, item in spans if x == s and start <= at <= end] == is_open[:1]


def test_a_local_folder_is_refused_off_local_mode(monkeypatch):
    from millrace import session

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError):
        session.shared_folder(type("S", (), {"sparkContext": Context()}))
