"""Candidate actions: spans of a table function, and every kept candidate against the rules once more."""

from pyspark.sql import functions as F

from millrace.operators import candidates as C
from millrace.operators import rules as R
from millrace.plans.policy import policy_log

SF_DIR = "/root/testdata/sf0.001"


def test_spans_are_words_with_utf16_places(spark):
    texts = ["two words", "", None, "\U0001f600 é-x", "  ", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    got = {}
    for r in df.lateralJoin(C.LexicalSpans(F.col("t").outer())).collect():
        got.setdefault(r["n"], []).append((r["nth"], r["span_start"], r["span_end"], r["span_text"]))
    assert got == {
        0: [(0, 0, 3, "two"), (1, 4, 9, "words"), (-1, 0, 9, "two words")],
        3: [(0, 3, 4, "é"), (1, 5, 6, "x"), (-1, 0, 6, texts[3])], 4: [(-1, 0, 2, "  ")], 5: [(0, 0, 1, "a"), (-1, 0, 1, "a")],
    }


def test_every_kept_candidate_passes_and_is_the_first_of_its_type(spark):
    log = policy_log(spark, SF_DIR)
    kept = C.allowed(log).cache()
    again = R.view(log, judged=kept)
    assert kept.count() > 100 and again.where(F.array_max(F.array(*R.rules().values()))).count() == 0
    assert kept.groupBy("session_id", "seq", "type").count().where("count > 1").isEmpty()
    assert kept.where("type = taken").isEmpty()
    every = C.synthetic(log).where("type <> taken")
    judged = R.view(log, judged=every).withColumn("bad", F.array_max(F.array(*R.rules().values())))
    first = judged.where(~F.col("bad")).groupBy("session_id", "seq", "type").agg(F.min("place").alias("least"))
    met = kept.join(first, ["session_id", "seq", "type"], "full")
    assert met.where("place IS NULL OR least IS NULL OR place <> least").isEmpty()
    kept.unpersist()


def test_judged_actions_change_nothing_in_the_log(spark):
    log = policy_log(spark, SF_DIR)
    own = R.parsed(log.actions)
    facts = ["floor_owned", "latest_snapshot", "oldest_failed", "n_active_timers", "timer_active", "is_repeat", "earlier_span", "earlier_mark"]
    as_log, as_judged = (sorted(map(str, v.select("session_id", "seq", "type", *facts).collect())) for v in (R.view(log), R.view(log, judged=own)))
    assert as_log == as_judged


def test_what_was_seen_is_found_once_for_all_kinds(spark):
    plan = C.synthetic(policy_log(spark, SF_DIR))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Relation" not in plan


def test_winners_judge_all_actions_in_one_view(spark, monkeypatch):
    views = []
    view = R.view
    monkeypatch.setattr(R, "view", lambda *args, **named: views.append(1) or view(*args, **named))
    C.winners(policy_log(spark, SF_DIR))
    assert len(views) == 1
