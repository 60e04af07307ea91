"""Named queries over what decisions rest on: winners, releases, timers' sources, ages, coverage and timing pools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import candidates
from millrace.operators import rules as R
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log
from millrace.plans.policy import POLICY_SQL, policy_log
from millrace.plans.rule_queries import VIEW_SQL, _broken, _CANDIDATES, view_sql

book = Book()

_ANY = " OR ".join(f"({_broken(code)})" for code in R.CODES)
_FIRST = "CASE " + " ".join(f"WHEN {_broken(code)} THEN '{code}'" for code in R.CODES) + " END"
_RANKS = "[" + ", ".join(f"'{t}'" for t in candidates.RANKING) + "]"
_BOTH = "UNION ALL BY NAME"


@book.query(view_sql("every", f"""{_CANDIDATES}, every AS (SELECT *, true AS offered FROM offered {_BOTH} SELECT *, type AS taken, false AS offered FROM act WHERE type IS NOT NULL)""") + f""",
w AS (SELECT session_id, seq, taken, offered, type, NOT ({_ANY}) AS fine FROM v)
SELECT session_id, seq, taken, bool_or(fine) FILTER (WHERE NOT offered) AS taken_allowed, arg_min(type, list_position({_RANKS}, type)) FILTER (WHERE fine) AS winner,
  coalesce(arg_min(type, list_position({_RANKS}, type)) FILTER (WHERE fine) = taken, false) AS wins FROM w GROUP BY session_id, seq, taken""")
def semantic_winner(spark, sf_dir):
    """At each decision the type that ranks first among all that could have been taken, and whether it was."""
    return candidates.winners(policy_log(spark, sf_dir))


def _released(variable: str, types: str, change: str) -> str:
    return f"SELECT session_id, seq, type, '{variable}' AS variable, blocked_by, {_FIRST} AS still_blocked_by FROM (SELECT * REPLACE ({change}) FROM b WHERE type IN ({types})) v"


@book.query(VIEW_SQL + f""", b AS MATERIALIZED (SELECT *, {_FIRST} AS blocked_by FROM v WHERE type IS NOT NULL),
r AS ({_released('request_pending', "'delegate'", 'false AS is_repeat')} UNION ALL {_released('floor_owned', "'respond'", 'false AS floor_owned')} UNION ALL {_released('timer_active', "'nudge', 'skip'", "(type = 'nudge') AS timer_active")})
SELECT *, still_blocked_by IS NULL AS released FROM r WHERE blocked_by IS NOT NULL""")
def one_variable_release(spark, sf_dir):
    """Blocked actions with one variable changed: which of them that alone would let pass."""
    return R.one_variable_releases(R.view(policy_log(spark, sf_dir)))


_KEYED = """'sha256:' || sha256('schedule-key-v1' || chr(0) || '{"instruction_id":"i_' || target_seq || '","interval_ms":' || interval_ms || ',"message":"' || message || '"}')"""


@book.query(f"""WITH {POLICY_SQL}, s AS (SELECT * FROM act WHERE type = 'schedule'), t AS (SELECT session_id, seq AS timer_seq, target_seq, span_start % 2 AS span_start, span_end, span_text, {_KEYED} AS idempotency_key FROM s),
c AS (SELECT session_id, target_seq, span_start, span_end, span_text, count(*) AS n, min(seq) AS seq FROM s GROUP BY ALL)
SELECT t.session_id, t.timer_seq, t.idempotency_key, CASE WHEN c.n = 1 THEN c.seq END AS source_seq, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'ambiguous' ELSE 'none' END AS problem
FROM t LEFT JOIN c ON c.session_id = t.session_id AND c.target_seq = t.target_seq AND c.span_start = t.span_start AND c.span_end = t.span_end AND c.span_text = t.span_text""")
def timer_sources(spark, sf_dir):
    """Timers, some with a span that is not theirs, and the schedule that each comes from by its span alone."""
    asked = R.parsed(policy_log(spark, sf_dir).actions).where("type = 'schedule'")
    span = ("target_seq", "span_start", "span_end", "span_text")
    key = R.schedule_key(F.concat(F.lit("i_"), F.col("target_seq").cast("string")), F.col("interval_ms"), F.col("message"))
    timers = asked.select("session_id", F.col("seq").alias("timer_seq"), "target_seq", (F.col("span_start") % 2).alias("span_start"), "span_end", "span_text", key.alias("idempotency_key"))
    return R.timer_sources(timers, asked, span).select("session_id", "timer_seq", "idempotency_key", "source_seq", "problem")


@book.query(f"""WITH {POLICY_SQL}, a AS (SELECT a.session_id, a.seq, a.target_seq, e.at_us AS read_us, a.at_us FROM act a JOIN ev e ON e.session_id = a.session_id AND e.seq = a.target_seq WHERE a.type IS NOT NULL)
SELECT session_id, seq, target_seq, CASE WHEN at_us >= back THEN CAST(floor((at_us - back) / 1000) AS BIGINT) END AS age_ms, at_us < back AS from_future
FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN at_us + 1 ELSE read_us END AS back FROM a)""")
def target_ages(spark, sf_dir):
    """How old the event that an action refers to was, in whole milliseconds; some are read with a clock that is ahead, and have no age."""
    log = policy_log(spark, sf_dir)
    acts = R.parsed(log.actions).where("type IS NOT NULL").select("session_id", "seq", "target_seq", "at_us")
    events = log.events.select("session_id", F.col("seq").alias("target_seq"), F.col("at_us").alias("_event_us"))
    back = F.when(F.col("seq") % 5 == 0, F.col("at_us") + 1).otherwise(F.col("_event_us"))
    met = acts.join(events, ["session_id", "target_seq"]).withColumn("_back", back)
    age = F.floor((F.col("at_us") - F.col("_back")) / 1000).cast("long")
    return met.select("session_id", "seq", "target_seq", F.when(F.col("at_us") >= F.col("_back"), age).alias("age_ms"), (F.col("at_us") < F.col("_back")).alias("from_future"))


@book.query(f"""WITH {POLICY_SQL}, h AS (SELECT session_id, count(*) FILTER (WHERE kind = 'fire') AS fires, count(*) FILTER (WHERE kind = 'fire' AND done_at IS NOT NULL) AS fires_done, count(*) FILTER (WHERE kind = 'result') AS results, count(*) FILTER (WHERE kind = 'result' AND done_at IS NOT NULL) AS results_done FROM ev GROUP BY session_id)
SELECT session_id, fires, fires_done, fires_done > 0 AS timer_fire_coverage, results, results_done, results_done > 0 AS tool_result_coverage, bool_or(fires_done > 0) OVER () AS any_fire_coverage, bool_or(results_done > 0) OVER () AS any_result_coverage FROM h""")
def policy_coverage(spark, sf_dir):
    """Whether a session's decisions ever handled a fire and a result, and whether any session's did."""
    log = policy_log(spark, sf_dir)
    done = R.with_dispositions(log.events, R.parsed(log.actions))
    of = lambda kind, closed: F.count_if((F.col("kind") == kind) & (F.col("done_at").isNotNull() if closed else F.lit(True)))
    each = done.groupBy("session_id").agg(of("fire", False).alias("fires"), of("fire", True).alias("fires_done"), of("result", False).alias("results"), of("result", True).alias("results_done"))
    covered = each.withColumns({"timer_fire_coverage": F.col("fires_done") > 0, "tool_result_coverage": F.col("results_done") > 0})
    both = covered.agg(F.max("timer_fire_coverage").alias("any_fire_coverage"), F.max("tool_result_coverage").alias("any_result_coverage"))
    return covered.join(F.broadcast(both))  # one row


@book.query(f"""WITH {LOG_SQL}, g AS (SELECT *, at_us - lag(at_us) OVER w AS gap, ['train', 'dev', 'test'][session_id % 3 + 1] AS split FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT kind AS regime, split, gap // 60000000 AS atom_minutes, count(*) AS n FROM g WHERE gap IS NOT NULL AND gap < 3600000000 GROUP BY ALL""")
def timing_atom_pools(spark, sf_dir):
    """The gaps within bursts that a regime and split may draw from, as counts of each value, however many there are."""
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("session_id") % 3 + 1).cast("int")).alias("split")
    gap = F.col("at_us") - F.lag("at_us").over(Window.partitionBy("session_id").orderBy("seq"))
    rows = event_log(spark, sf_dir).withColumn("gap", gap).where("gap IS NOT NULL AND gap < 3600000000")
    return rows.groupBy(F.col("kind").alias("regime"), split, F.floor(F.col("gap") / 60_000_000).cast("long").alias("atom_minutes")).agg(F.count(F.lit(1)).alias("n"))


@book.query(f"""WITH {LOG_SQL}, g AS (SELECT *, lag(at_us) OVER w AS before, lag(kind) OVER w AS kind_before FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq AS first_seq, kind, (at_us - before) // 1000 AS initial_delay_ms FROM g WHERE kind_before IS DISTINCT FROM kind""")
def slice_initial_delays(spark, sf_dir):
    """The first row of each run of one kind, and how long after the input before it came; null at a session's start."""
    by = Window.partitionBy("session_id").orderBy("seq")
    rows = event_log(spark, sf_dir).withColumns({"_at": F.lag("at_us").over(by), "_kind": F.lag("kind").over(by)})
    delay = F.floor((F.col("at_us") - F.col("_at")) / 1000).cast("long")
    return rows.where(~F.col("_kind").eqNullSafe(F.col("kind"))).select("session_id", F.col("seq").alias("first_seq"), "kind", delay.alias("initial_delay_ms"))
