"""The ``events`` table read as policy logs: who said, fired, answered and did what; and the same in SQL.

A user is a session. A view is a snapshot of the text "note k", a click the fire of timer k mod 16, an error the result
of request k mod 4, a signup the scheduling of a timer, and a purchase an action, whose fields are drawn from k and the
event's id. Actions take effect as they stand, whatever the rules say of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rules import TYPES, PolicyLog, parsed
from millrace.plans.log import LOG_SQL, event_log

KINDS = {"view": "snapshot", "click": "fire", "error": "result"}
IDLE_REASONS = ("awaiting_tool", "awaiting_opening", "already_handled", "no_new_instruction")
SKIP_REASONS = ("canceled_timer", "stale_result")
TIMERS = 16


def _pick(names: tuple[str, ...], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def policy_log(spark: SparkSession, sf_dir: str) -> PolicyLog:
    log = event_log(spark, sf_dir)
    k, e, seq, kind = F.col("k"), F.col("event_id"), F.col("seq"), F.col("kind")
    means = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), kind), F.lit("other"))
    events = log.select(
        "session_id", "seq", "at_us", means.alias("kind"),
        F.when(kind == "view", F.concat(F.lit("note "), k.cast("string"))).alias("text"),
        F.when(kind == "view", k % 3 == 0).alias("active"), F.when(kind == "view", k % 7 == 0).alias("composing"),
        F.when(kind == "click", k % TIMERS).alias("timer"), F.when(kind == "error", k % 4).alias("request"),
        F.when(kind == "error", F.floor(k / 4) % 3 > 0).alias("succeeded"),
    )
    name = _pick(TYPES, k % 9)
    raw = F.when(e % 13 == 0, "{broken").when(e % 13 == 1, '{"type":"sing"}').otherwise(F.to_json(F.struct(name.alias("type"))))
    start = k % 3
    actions = log.where("kind = 'purchase'").select(
        "session_id", "seq", "at_us", raw.alias("raw"), (seq - 1 - e % 6).alias("target_seq"),
        F.when(name == "skip", _pick(SKIP_REASONS, e % 2)).otherwise(_pick(IDLE_REASONS, e % 4)).alias("reason"),
        start.alias("span_start"), (start + 4).alias("span_end"), F.lit("note 1").substr((start + 1).cast("int"), F.lit(4)).alias("span_text"),
        (seq - 1 - F.floor(e / 6) % 3).alias("mark_seq"), (k % 5 * 15_000).alias("interval_ms"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("message"),
        (k % 4).alias("request"), (k % TIMERS).alias("timer"), (e % 5 == 0).alias("cancel_all"),
        F.floor(F.col("value") * 10).alias("payload_bytes"), (seq - 1 - e % 3).alias("observed_seq"),
    )
    # One pass over the log: as a union of four kinds of change, each would read and sort the whole log again.
    every = F.sequence(F.lit(0).cast("long"), F.lit(TIMERS - 1).cast("long"))
    does = log.where("kind IN ('signup', 'purchase')").select("session_id", "seq", "kind", raw.alias("raw"), (k % TIMERS).alias("timer"), (e % 5 == 0).alias("cancel_all"))
    to = lambda timer, active: F.struct(timer.alias("timer"), F.lit(active).alias("active"))
    kind, act, timer = F.col("kind"), F.col("type"), F.col("timer")
    changes = (
        F.when((kind == "signup") | (act == "schedule"), F.array(to(timer, True)))
        .when((act == "cancel") & ~F.col("cancel_all"), F.array(to(timer, False)))
        .when((act == "cancel") & F.col("cancel_all"), F.transform(every, lambda t: to(t, False)))
    )
    changed = parsed(does).select("session_id", "seq", F.explode(changes).alias("c")).select("session_id", "seq", "c.timer", "c.active")
    return PolicyLog(events, actions, changed)


_NAMES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
#: CTEs log, ev (events with done_at), act (typed actions), asked (delegations) and changed (timer changes).
POLICY_SQL = f"""{LOG_SQL}, act AS (
  SELECT session_id, seq, at_us, CASE WHEN event_id % 13 > 1 THEN {_NAMES}[k % 9 + 1] END AS type, seq - 1 - event_id % 6 AS target_seq,
         CASE WHEN k % 9 = 4 THEN ['canceled_timer', 'stale_result'][event_id % 2 + 1]
              ELSE ['awaiting_tool', 'awaiting_opening', 'already_handled', 'no_new_instruction'][event_id % 4 + 1] END AS reason,
         k % 3 AS span_start, k % 3 + 4 AS span_end, substr('note 1', k % 3 + 1, 4) AS span_text, seq - 1 - (event_id // 6) % 3 AS mark_seq,
         k % 5 * 15000 AS interval_ms, 'm' || k % 2 AS message, k % 4 AS request, k % 16 AS timer, event_id % 5 = 0 AS cancel_all,
         CAST(floor(value * 10) AS BIGINT) AS payload_bytes, seq - 1 - event_id % 3 AS observed_seq
  FROM log WHERE kind = 'purchase'
), ev AS (
  SELECT session_id, seq, at_us, CASE kind WHEN 'view' THEN 'snapshot' WHEN 'click' THEN 'fire' WHEN 'error' THEN 'result' ELSE 'other' END AS kind,
         CASE WHEN kind = 'view' THEN 'note ' || k END AS text, kind = 'view' AND k % 3 = 0 AS active, kind = 'view' AND k % 7 = 0 AS composing,
         CASE WHEN kind = 'click' THEN k % 16 END AS timer, CASE WHEN kind = 'error' THEN k % 4 END AS request, k // 4 % 3 > 0 AS succeeded,
         (SELECT min(a.seq) FROM act a WHERE a.session_id = log.session_id AND a.target_seq = log.seq
            AND (a.type = 'respond' AND log.kind IN ('view', 'click', 'error') OR a.type IN ('integrate', 'skip', 'nudge') AND log.kind IN ('click', 'error'))) AS done_at
  FROM log
), asked AS (
  SELECT a.session_id, a.seq, a.request, a.target_seq AS fact_seq,
         (SELECT min(r.seq) FROM ev r WHERE r.session_id = a.session_id AND r.kind = 'result' AND r.request = a.request AND r.seq > a.seq) AS done_at
  FROM act a WHERE a.type = 'delegate'
), changed AS (
  SELECT session_id, seq, k % 16 AS timer, true AS active FROM log WHERE kind = 'signup'
  UNION ALL SELECT session_id, seq, timer, true FROM act WHERE type = 'schedule'
  UNION ALL SELECT session_id, seq, timer, false FROM act WHERE type = 'cancel' AND NOT cancel_all
  UNION ALL SELECT session_id, seq, t.timer, false FROM act, range(16) t(timer) WHERE type = 'cancel' AND cancel_all
)"""
