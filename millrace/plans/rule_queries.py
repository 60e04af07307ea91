"""Named queries over the rules: the view of each action, one query for each block code, and the ledgers they read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators import candidates
from millrace.operators import rules as R
from millrace.operators import state as S
from millrace.plans.book import Book
from millrace.plans.policy import POLICY_SQL, policy_log

book = Book()


def _among(what: str, kind: str, more: str) -> str:
    return f"(SELECT {what} FROM ev x WHERE x.session_id = a.session_id AND x.seq < a.seq AND x.kind = '{kind}' AND {more})"


_OPEN = "(x.done_at IS NULL OR x.done_at >= a.seq)"
_STATUS = "(SELECT arg_max(active, c.seq) FROM changed c WHERE c.session_id = a.session_id AND c.timer = {} AND c.seq < a.seq)"
def view_sql(source: str, before: str = "") -> str:
    """The view of the actions in ``source``, which has the columns of ``act``; ``before`` are CTEs that make it."""
    return f"""WITH {POLICY_SQL}{before}, counted AS (
  SELECT session_id, seq, count(*) FILTER (WHERE active) AS n FROM (
    SELECT a.session_id, a.seq, c.timer, arg_max(c.active, c.seq) AS active FROM (SELECT DISTINCT session_id, seq FROM {source}) a JOIN changed c ON c.session_id = a.session_id AND c.seq < a.seq GROUP BY ALL)
  GROUP BY ALL
), seen AS (
  SELECT a.*, t.kind AS t_kind, t.text AS t_text, t.timer AS t_timer, t.succeeded AS t_succeeded, t.done_at IS NULL OR t.done_at >= a.seq AS t_open,
         m.kind AS m_kind, m.text AS m_text, {_among('max(x.seq)', 'snapshot', 'true')} AS latest_snapshot,
         {_among('min(x.seq)', 'result', f'x.succeeded AND {_OPEN}')} AS oldest_succeeded, {_among('min(x.seq)', 'result', f'NOT x.succeeded AND {_OPEN}')} AS oldest_failed,
         (SELECT arg_min(d.fact_seq, d.seq) FROM asked d WHERE d.session_id = a.session_id AND d.seq < a.seq AND (d.done_at IS NULL OR d.done_at >= a.seq)) AS oldest_pending_fact,
         (SELECT count(*) FROM asked d WHERE d.session_id = a.session_id AND d.request = a.request AND d.seq < a.seq AND (d.done_at IS NULL OR d.done_at > a.seq)) > 0 AND a.type = 'delegate' AS is_repeat,
         (SELECT min(x.seq) FROM ev x WHERE x.session_id = a.session_id AND x.done_at < a.seq) AS earliest_handled,
         coalesce(n.n, 0) AS n_active_timers, CASE WHEN a.type = 'cancel' THEN a.timer ELSE t.timer END AS meant
  FROM {source} a LEFT JOIN ev t ON t.session_id = a.session_id AND t.seq = a.target_seq LEFT JOIN ev m ON m.session_id = a.session_id AND m.seq = a.mark_seq
       LEFT JOIN counted n ON n.session_id = a.session_id AND n.seq = a.seq
), v AS MATERIALIZED (
  SELECT a.*, coalesce(l.active OR l.composing, false) AS floor_owned, coalesce(a.latest_snapshot > a.observed_seq, false) AS newer_snapshot, {_STATUS.format('a.meant')} AS timer_active,
         l.text AS l_text,
         EXISTS (SELECT 1 FROM act b WHERE b.session_id = a.session_id AND b.type = 'mark' AND b.seq < a.seq AND b.target_seq IS NOT DISTINCT FROM a.target_seq
           AND b.mark_seq IS NOT DISTINCT FROM a.mark_seq AND b.span_start IS NOT DISTINCT FROM a.span_start) AS earlier_mark
  FROM seen a LEFT JOIN ev l ON l.session_id = a.session_id AND l.seq = a.latest_snapshot
)"""


VIEW_SQL = view_sql("act")
_CUT = "NOT coalesce({0}_kind = 'snapshot' AND length({0}_text) >= span_end AND substr({0}_text, span_start + 1, span_end - span_start) = span_text, false)"
_RULES_SQL = {
    "malformed_action": "type IS NULL",
    "payload_limit_exceeded": "payload_bytes > 1500",
    "unknown_reference": """(type <> 'idle' OR reason <> 'no_new_instruction') AND t_kind IS NULL OR type = 'mark' AND m_kind IS NULL
      OR type = 'cancel' AND NOT cancel_all AND timer_active IS NULL OR type = 'respond' AND NOT (t_kind = 'snapshot' OR t_kind = 'result' AND NOT t_succeeded)""",
    "reason_mismatch": """CASE WHEN type = 'idle' AND reason = 'awaiting_tool' THEN oldest_pending_fact IS DISTINCT FROM target_seq
      WHEN type = 'idle' AND reason = 'awaiting_opening' THEN coalesce(oldest_succeeded, oldest_failed, latest_snapshot) IS DISTINCT FROM target_seq
      WHEN type = 'idle' AND reason = 'already_handled' THEN earliest_handled IS DISTINCT FROM target_seq
      WHEN type = 'respond' AND t_kind = 'result' AND NOT t_succeeded AND t_open THEN oldest_failed IS DISTINCT FROM target_seq
      WHEN type = 'respond' AND t_kind = 'snapshot' THEN oldest_failed IS NOT NULL OR latest_snapshot IS DISTINCT FROM target_seq
      WHEN type = 'skip' AND reason = 'canceled_timer' THEN NOT coalesce(t_kind = 'fire' AND NOT coalesce(timer_active, true), false)
      WHEN type = 'skip' THEN t_kind IS DISTINCT FROM 'result' END""",
    "span_mismatch": f"""type IN ('mark', 'delegate', 'schedule', 'cancel') AND {_CUT.format('t')}
      OR type = 'mark' AND ({_CUT.format('m')} OR mark_seq IS DISTINCT FROM latest_snapshot)""",
    "result_not_ready": "type = 'integrate' AND NOT coalesce(t_kind = 'result' AND t_succeeded, false)",
    "fire_not_open": "type = 'nudge' AND NOT coalesce(t_kind = 'fire' AND t_open, false)",
    "timer_not_active": """type = 'nudge' AND t_kind = 'fire' AND NOT coalesce(timer_active, false)
      OR type = 'cancel' AND CASE WHEN cancel_all THEN n_active_timers = 0 ELSE NOT coalesce(timer_active, false) END""",
    "duplicate_schedule": """type = 'schedule' AND EXISTS (SELECT 1 FROM act b WHERE b.session_id = v.session_id AND b.seq < v.seq AND b.type = 'schedule'
      AND b.span_start = v.span_start AND b.span_end = v.span_end AND b.span_text = v.span_text AND (b.target_seq = v.target_seq
      OR v.target_seq = v.latest_snapshot AND length(l_text) >= v.span_end AND substr(l_text, v.span_start + 1, v.span_end - v.span_start) = v.span_text))""",
    "duplicate_tool_request": "type = 'delegate' AND is_repeat",
    "floor_owned": "type = 'respond' AND floor_owned",
    "target_already_handled": """type = 'mark' AND earlier_mark OR type IN ('integrate', 'skip') AND NOT coalesce(t_kind IN ('fire', 'result') AND t_open, false)
      OR type = 'respond' AND t_kind IN ('result', 'snapshot') AND NOT t_open""",
    "timer_limit_exceeded": "type = 'schedule' AND (interval_ms NOT BETWEEN 5000 AND 45000 OR n_active_timers >= 4)",
    "stale_decision": "type = 'respond' AND newer_snapshot",
}


def _broken(code: str) -> str:
    return _RULES_SQL[code] if code == "malformed_action" else f"type IS NOT NULL AND coalesce({_RULES_SQL[code]}, false)"


_FACTS = ("floor_owned", "newer_snapshot", "latest_snapshot", "oldest_succeeded", "oldest_failed", "oldest_pending_fact", "earliest_handled", "n_active_timers", "timer_active")


@book.query(VIEW_SQL + f" SELECT session_id, seq, type, t_kind AS target_kind, {', '.join(_FACTS)} FROM v")
def license_view(spark, sf_dir):
    return R.view(policy_log(spark, sf_dir)).select("session_id", "seq", "type", F.col("target.kind").alias("target_kind"), *_FACTS)


def _enter(code: str) -> None:
    marked = f", w AS MATERIALIZED (SELECT session_id, seq, type, target_seq, {_broken(code)} AS hit FROM v)"

    @book.query(f"{VIEW_SQL}{marked} SELECT session_id, seq, type, target_seq FROM w WHERE hit", name=f"rule_{code}")
    def blocked(spark, sf_dir):
        return R.view(policy_log(spark, sf_dir), R.NEEDS[code]).where(R.rules()[code]).select("session_id", "seq", "type", "target_seq")


for _code in R.CODES:
    _enter(_code)

@book.query(f"""WITH {POLICY_SQL} SELECT session_id, seq, interval_ms, message, CAST(nth AS INTEGER) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, interval_ms, message ORDER BY seq) AS nth FROM act WHERE type = 'schedule') WHERE nth > 1""")
def semantic_duplicate_schedule(spark, sf_dir):
    return R.semantic_repeats(policy_log(spark, sf_dir).actions)


_LADDER = "[" + ", ".join(f"CASE WHEN {_broken(code)} THEN '{code}' END" for code in R.CODES) + "]"


@book.query(VIEW_SQL + f""", b AS (SELECT session_id, seq, list_filter({_LADDER}, lambda x: x IS NOT NULL) AS codes FROM v)
SELECT session_id, seq, codes[1] AS first_block, array_to_string(codes, '+') AS all_blocks FROM b""")
def license_check(spark, sf_dir):
    ruled = S.blocks(R.view(policy_log(spark, sf_dir)), R.rules())
    return ruled.select("session_id", "seq", "first_block", F.array_join("all_blocks", "+").alias("all_blocks"))


@book.query(f"WITH {POLICY_SQL} SELECT session_id, min(timer) AS first_timer, count(*) AS n FROM (SELECT session_id, timer, arg_max(active, seq) AS active FROM changed GROUP BY ALL) WHERE active GROUP BY session_id")
def active_timer_ledger(spark, sf_dir):
    latest = J.latest(policy_log(spark, sf_dir).timer_changes, ["session_id", "timer"], ["seq"])
    return latest.where("active").groupBy("session_id").agg(F.min("timer").alias("first_timer"), F.count(F.lit(1)).alias("n"))


def _requests(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    return R.requests(R.parsed(log.actions), log.events)


@book.query(f"""WITH {POLICY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, request ORDER BY seq) AS nth FROM asked WHERE done_at IS NULL)
SELECT session_id, request, seq, fact_seq FROM r WHERE nth = 1""")
def pending_tool_requests(spark, sf_dir):
    pending = _requests(spark, sf_dir).where("done_at IS NULL AND NOT is_repeat")
    return pending.select("session_id", "request", "seq", "fact_seq")


@book.query(f"""WITH {POLICY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, request, done_at ORDER BY seq) AS nth FROM asked WHERE done_at IS NOT NULL)
SELECT r.session_id, r.done_at AS result_seq, r.seq AS request_seq, e.succeeded FROM r JOIN ev e ON e.session_id = r.session_id AND e.seq = r.done_at WHERE r.nth = 1""")
def result_request_join(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    first = R.requests(R.parsed(log.actions), log.events).where("done_at IS NOT NULL AND NOT is_repeat")
    asked = first.select("session_id", F.col("done_at").alias("result_seq"), F.col("seq").alias("request_seq"))
    results = log.events.where("kind = 'result'").select("session_id", F.col("seq").alias("result_seq"), "succeeded")
    return asked.join(results, ["session_id", "result_seq"])


_TERMINAL = "x.kind = 'result' AND x.done_at IS NULL"


@book.query(f"""WITH {POLICY_SQL} SELECT session_id, arg_min(seq, (CASE WHEN succeeded THEN 0 ELSE 1 END, seq)) AS seq, bool_or(succeeded) AS succeeded FROM ev x WHERE {_TERMINAL} GROUP BY session_id""")
def oldest_open_result(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    left = R.with_dispositions(log.events, R.parsed(log.actions)).where("kind = 'result' AND done_at IS NULL")
    rank = F.struct(F.when(F.col("succeeded"), 0).otherwise(1), F.col("seq"))
    return left.groupBy("session_id").agg(F.min_by("seq", rank).alias("seq"), F.bool_or("succeeded").alias("succeeded"))


@book.query(f"""WITH {POLICY_SQL} SELECT session_id, count(*) FILTER (WHERE kind = 'fire' AND done_at IS NULL) AS open_fires, count(*) FILTER (WHERE kind = 'result' AND succeeded AND done_at IS NULL) AS live_results,
  count(*) FILTER (WHERE kind = 'result' AND NOT succeeded AND done_at IS NULL) AS failed_results, count(*) FILTER (WHERE kind IN ('fire', 'result') AND done_at IS NOT NULL) AS stale FROM ev GROUP BY session_id""")
def open_event_partition(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    left = R.with_dispositions(log.events, R.parsed(log.actions))
    is_open, kind = F.col("done_at").isNull(), F.col("kind")
    return left.groupBy("session_id").agg(
        F.count_if((kind == "fire") & is_open).alias("open_fires"), F.count_if((kind == "result") & F.col("succeeded") & is_open).alias("live_results"),
        F.count_if((kind == "result") & ~F.col("succeeded") & is_open).alias("failed_results"), F.count_if(kind.isin("fire", "result") & ~is_open).alias("stale"),
    )


@book.query(f"""WITH {POLICY_SQL} SELECT DISTINCT x.session_id FROM ev x WHERE x.kind IN ('fire', 'result') AND x.done_at IS NULL""")
def sessions_with_open_actionable(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    left = R.with_dispositions(log.events, R.parsed(log.actions)).where("kind IN ('fire', 'result') AND done_at IS NULL").select("session_id")
    return log.events.select("session_id").distinct().join(left, "session_id", "left_semi")


@book.query(f"""WITH {POLICY_SQL}, l AS (SELECT session_id, arg_max(active OR composing, seq) AS owned, max(seq) AS seq FROM ev WHERE kind = 'snapshot' GROUP BY session_id) SELECT session_id, seq, owned FROM l""")
def floor_owner_latest(spark, sf_dir):
    snapshots = policy_log(spark, sf_dir).events.where("kind = 'snapshot'").select("session_id", "seq", (F.col("active") | F.col("composing")).alias("owned"))
    return J.latest(snapshots, ["session_id"], ["seq"])


@book.query(f"""WITH {POLICY_SQL}, m AS (SELECT *, max(CASE WHEN kind = 'snapshot' THEN seq END) OVER (PARTITION BY session_id) AS last FROM ev)
SELECT session_id, seq, kind, CASE WHEN kind = 'snapshot' AND seq = last THEN '<masked>' ELSE text END AS text FROM m""")
def masked_latest_snapshot(spark, sf_dir):
    events = policy_log(spark, sf_dir).events
    last = F.max(F.when(F.col("kind") == "snapshot", F.col("seq"))).over(Window.partitionBy("session_id"))
    is_last = (F.col("kind") == "snapshot") & (F.col("seq") == F.col("last"))
    return events.withColumn("last", last).select("session_id", "seq", "kind", F.when(is_last, "<masked>").otherwise(F.col("text")).alias("text"))


@book.query(f"""WITH {POLICY_SQL} SELECT session_id, seq, kind, coalesce(done_at IS NOT NULL, false) AS handled, (SELECT a.type FROM act a WHERE a.session_id = ev.session_id AND a.seq = ev.done_at) AS by_type
FROM ev WHERE kind <> 'other'""")
def event_dispositions(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    done = R.parsed(log.actions)
    events = R.with_dispositions(log.events, done).where("kind <> 'other'")
    by = done.select("session_id", F.col("seq").alias("done_at"), F.col("type").alias("by_type"))
    return events.join(by, ["session_id", "done_at"], "left").select("session_id", "seq", "kind", F.col("done_at").isNotNull().alias("handled"), "by_type")


@book.query(f"""WITH {POLICY_SQL}, s AS (SELECT session_id, count(*) AS n_events, max(seq) AS last_seq, count(*) FILTER (WHERE kind IN ('fire', 'result') AND done_at IS NULL) AS open_events FROM ev GROUP BY session_id),
t AS (SELECT session_id, count(*) FILTER (WHERE active) AS active_timers FROM (SELECT session_id, timer, arg_max(active, seq) AS active FROM changed GROUP BY ALL) GROUP BY session_id),
p AS (SELECT session_id, count(DISTINCT request) AS pending FROM asked WHERE done_at IS NULL GROUP BY session_id), w AS (SELECT session_id, count(*) FILTER (WHERE type IS NULL) AS rejected FROM act GROUP BY session_id)
SELECT s.session_id, n_events, last_seq, open_events, coalesce(active_timers, 0) AS active_timers, coalesce(pending, 0) AS pending_requests, coalesce(rejected, 0) AS rejected FROM s LEFT JOIN t USING (session_id) LEFT JOIN p USING (session_id) LEFT JOIN w USING (session_id)""")
def session_ledger_snapshot(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    done = R.parsed(log.actions)
    is_open = F.col("kind").isin("fire", "result") & F.col("done_at").isNull()
    events = R.with_dispositions(log.events, done).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last_seq"), F.count_if(is_open).alias("open_events"))
    timers = J.latest(log.timer_changes, ["session_id", "timer"], ["seq"]).groupBy("session_id").agg(F.count_if("active").alias("active_timers"))
    pending = R.requests(done, log.events).where("done_at IS NULL AND NOT is_repeat").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending_requests"))
    rejected = done.groupBy("session_id").agg(F.count_if(F.col("type").isNull()).alias("rejected"))
    out = events
    for part in (timers, pending, rejected):
        out = out.join(part, "session_id", "left")
    return out.fillna(0, ["active_timers", "pending_requests", "rejected"])


_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295)"
_NONE = "NULL::BIGINT AS target_seq, NULL AS reason, NULL::INT AS span_start, NULL::INT AS span_end, NULL AS span_text, NULL::BIGINT AS mark_seq, NULL::BIGINT AS interval_ms, NULL AS message, NULL::BIGINT AS request, NULL::BIGINT AS timer, NULL::BOOLEAN AS cancel_all"


def _candidate(kind: str, group: int, place: str, source: str, **columns: str) -> str:
    made = _NONE
    for name, value in columns.items():
        made = ", ".join(f"{value} AS {name}" if part.endswith(f" AS {name}") else part for part in made.split(", "))
    text = columns.get("message") or columns.get("span_text") or "''"
    return f"SELECT session_id, seq, taken, '{kind}' AS type, {made}, latest AS observed_seq, strlen({text}) AS payload_bytes, {group} * 1000 + {place} AS place FROM {source}"


_SPAN = {"span_start": "w0", "span_end": "w1", "span_text": "w"}
_WHOLE = {"span_start": "0", "span_end": "length(latest_text)", "span_text": "latest_text"}
_HERE = {"target_seq": "latest"}
_CANDIDATES = f""", crc_table AS (SELECT list(CAST(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS BIGINT) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
dec AS (SELECT a.session_id, a.seq, a.type AS taken, {_among('max(x.seq)', 'snapshot', 'true')} AS latest, {_among('min(x.seq)', 'result', _OPEN)} AS open_result, {_among('min(x.seq)', 'fire', _OPEN)} AS open_fire,
  (SELECT min(timer) FROM (SELECT timer, arg_max(active, c.seq) AS on_now FROM changed c WHERE c.session_id = a.session_id AND c.seq < a.seq GROUP BY timer) WHERE on_now) AS first_active FROM act a WHERE a.type IS NOT NULL),
seen0 AS (SELECT d.*, coalesce(s.text, '') AS latest_text, f.timer AS fire_timer, (SELECT arg_max(active, c.seq) FROM changed c WHERE c.session_id = d.session_id AND c.timer = f.timer AND c.seq < d.seq) AS fire_active
  FROM dec d LEFT JOIN ev s ON s.session_id = d.session_id AND s.seq = d.latest LEFT JOIN ev f ON f.session_id = d.session_id AND f.seq = d.open_fire),
words AS (SELECT *, 0 AS nth, 0 AS w0, 4 AS w1, latest_text[1:4] AS w FROM seen0 WHERE latest_text <> '' UNION ALL SELECT *, 1, 5, length(latest_text), latest_text[6:] FROM seen0 WHERE latest_text <> ''),
spans AS (SELECT * FROM words UNION ALL SELECT *, 999, 0, length(latest_text), latest_text FROM seen0 WHERE latest_text <> ''),
cand AS ({' UNION ALL '.join((
    _candidate('idle', 0, '0', 'seen0', reason="'no_new_instruction'"),
    _candidate('mark', 1, 'nth', 'words', mark_seq='latest', **_HERE, **_SPAN),
    _candidate('delegate', 2, 'nth', 'words, crc_table', request=f'{_CRC} % 4', **_HERE, **_SPAN),
    _candidate('schedule', 3, 'nth', 'spans', interval_ms='45000', message='trim(w)', **_HERE, **_SPAN),
    _candidate('respond', 4, '0', "seen0 WHERE latest_text <> ''", message="'Understood.'", **_HERE),
    _candidate('cancel', 5, '0', "seen0 WHERE latest_text <> '' AND first_active IS NOT NULL", timer='first_active', cancel_all='false', **_HERE, **_WHOLE),
    _candidate('skip', 6, '0', 'seen0 WHERE open_result IS NOT NULL', target_seq='open_result', reason="'stale_result'"),
    _candidate('nudge', 7, '0', 'seen0 WHERE fire_active', target_seq='open_fire', timer='fire_timer'),
    _candidate('skip', 8, '0', 'seen0 WHERE NOT fire_active', target_seq='open_fire', reason="'canceled_timer'", timer='fire_timer'),
))}), offered AS (SELECT * FROM cand WHERE type <> taken)"""
_SHOWN = ("target_seq", "reason", "span_start", "span_text", "message", "request", "timer")


@book.query(view_sql("offered", _CANDIDATES) + f""", fine AS (SELECT * FROM v WHERE NOT ({' OR '.join(f'({_broken(code)})' for code in R.CODES)}))
SELECT session_id, seq, taken, type, {', '.join(_SHOWN)} FROM fine QUALIFY row_number() OVER (PARTITION BY session_id, seq, type ORDER BY place) = 1""")
def listwise_candidates(spark, sf_dir):
    """Beside each decision, the first action of every other type that could have been taken there and that no rule blocks."""
    found = candidates.allowed(policy_log(spark, sf_dir))
    return found.select("session_id", "seq", "taken", "type", *_SHOWN)
