"""Named queries over ordered logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import sequence as S
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log, turn_log
from millrace.session import table

book = Book()
HOUR_US = 3_600_000_000
ORDER = ["seq"]
BURST_SQL = f"""{LOG_SQL}, gaps AS (
  SELECT *, at_us - lag(at_us) OVER (PARTITION BY session_id ORDER BY seq) AS gap FROM log
), bursts AS (
  SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap >= {HOUR_US} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS burst FROM gaps
), summary AS (
  SELECT session_id, burst, count(*) AS n_events, CAST(sum(k) AS BIGINT) AS weight, (max(at_us) - min(at_us)) // 1000 AS duration_ms
  FROM bursts GROUP BY session_id, burst
)"""
SEGMENT_SQL = f"""{LOG_SQL}, segmented AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS segment_index FROM log
)"""


def _segmented(spark, sf_dir):
    return S.segment(event_log(spark, sf_dir), "session_id", ORDER, F.col("kind") == "signup")


@book.query(f"""WITH {LOG_SQL}
SELECT session_id, seq, event_id, format('e_{{:06d}}', seq) AS log_id,
       coalesce((at_us - lag(at_us) OVER (PARTITION BY session_id ORDER BY seq)) // 1000, 0) AS dt_ms FROM log""")
def event_log_sequence(spark, sf_dir):
    log = S.elapsed(event_log(spark, sf_dir), "session_id", ORDER, "at_us")
    return log.select("session_id", "seq", "event_id", F.format_string("e_%06d", "seq").alias("log_id"), "dt_ms")


@book.query(f"WITH {BURST_SQL} SELECT session_id, seq, burst FROM bursts")
def event_bursts(spark, sf_dir):
    return S.burst(event_log(spark, sf_dir), "session_id", ORDER, "at_us", HOUR_US).select("session_id", "seq", "burst")


@book.query(f"WITH {BURST_SQL} SELECT * FROM summary")
def burst_summary(spark, sf_dir):
    return S.burst_summary(event_log(spark, sf_dir), "session_id", ORDER, "at_us", HOUR_US, F.col("k"))


@book.query(f"""WITH {BURST_SQL}
SELECT session_id, count(*) AS n_bursts, round(quantile_cont(duration_ms, 0.1), 6) AS p10, round(quantile_cont(duration_ms, 0.5), 6) AS p50,
       round(quantile_cont(duration_ms, 0.9), 6) AS p90 FROM summary GROUP BY session_id""")
def burst_summary_percentiles(spark, sf_dir):
    bursts = S.burst_summary(event_log(spark, sf_dir), "session_id", ORDER, "at_us", HOUR_US, F.col("k"))
    at = F.percentile("duration_ms", F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    return bursts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_bursts"), at.alias("p")).select(
        "session_id", "n_bursts", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90")))
    )


@book.query(f"""WITH {BURST_SQL}
SELECT session_id, seq, gap // 1000 AS gap_ms, gap < {HOUR_US} AS within_burst FROM bursts WHERE gap IS NOT NULL""")
def burst_gaps(spark, sf_dir):
    gap = F.col("at_us") - F.lag("at_us").over(S.ordered("session_id", ORDER))
    log = event_log(spark, sf_dir).withColumn("gap", gap).where("gap IS NOT NULL")
    return log.select("session_id", "seq", F.floor(F.col("gap") / 1000).cast("long").alias("gap_ms"), (F.col("gap") < HOUR_US).alias("within_burst"))


@book.query(f"WITH {SEGMENT_SQL} SELECT session_id, segment_index, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq FROM segmented GROUP BY ALL")
def segment_rollover_index(spark, sf_dir):
    return _segmented(spark, sf_dir).groupBy("session_id", "segment_index").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@book.query(f"""WITH {SEGMENT_SQL}
SELECT session_id, segment_index, seq, coalesce((at_us - lag(at_us) OVER (PARTITION BY session_id, segment_index ORDER BY seq)) // 1000, 0) AS dt_ms FROM segmented""")
def segment_dt(spark, sf_dir):
    log = S.elapsed(_segmented(spark, sf_dir), "session_id", ORDER, "at_us", segment="segment_index")
    return log.select("session_id", "segment_index", "seq", "dt_ms")


LINE_SQL = "'{\"seq\":' || seq || ',\"kind\":\"' || kind || '\",\"k\":' || k || '}'"


@book.query(f"""WITH {SEGMENT_SQL}, segments AS (
  SELECT session_id, segment_index, count(*) AS n_events, 'sha256:' || sha256(string_agg({LINE_SQL}, chr(10) ORDER BY seq)) AS segment_hash
  FROM segmented GROUP BY session_id, segment_index)
SELECT *, lag(segment_hash) OVER (PARTITION BY session_id ORDER BY segment_index) AS previous_hash FROM segments""")
def segment_hash_chain(spark, sf_dir):
    line = F.to_json(F.struct("seq", "kind", "k"))
    segments = S.rendered_segments(_segmented(spark, sf_dir), ["session_id", "segment_index"], "seq", line)
    return S.hash_chain(segments, "session_id", "segment_index").drop("segment_text")


@book.query(f"""WITH {LOG_SQL}, runs AS (
  SELECT *, sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS island FROM log
), counted AS (SELECT session_id, island, count(*) AS n FROM runs WHERE kind = 'error' GROUP BY session_id, island)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY island) AS run, n FROM counted""")
def error_run_lengths(spark, sf_dir):
    return S.runs(event_log(spark, sf_dir), "session_id", ORDER, F.col("kind") == "error")


@book.query(f"""WITH {LOG_SQL}, pairs AS (SELECT lag(kind) OVER (PARTITION BY session_id ORDER BY seq) AS from_state, kind AS to_state FROM log)
SELECT from_state, to_state, count(*) AS n FROM pairs WHERE from_state IS NOT NULL GROUP BY ALL""")
def activity_transition_matrix(spark, sf_dir):
    return S.transitions(event_log(spark, sf_dir), "session_id", ORDER, "kind")


@book.query("""WITH sized AS (SELECT conv_id, turn, role, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS change FROM conversations)
SELECT conv_id, turn, change, coalesce(change < 0, false) AS is_revision FROM sized WHERE role = 'user'""")
def turn_revisions(spark, sf_dir):
    sized = turn_log(spark, sf_dir).withColumn("size", F.char_length("text").cast("long"))
    return S.revisions(sized, "conv_id", ["turn"], "size").where("role = 'user'").select("conv_id", "turn", "change", "is_revision")


@book.query(f"""WITH {LOG_SQL}, moved AS (SELECT session_id, seq, abs(k - lag(k) OVER (PARTITION BY session_id ORDER BY seq)) AS travel FROM log)
SELECT session_id, CAST(sum(travel) AS BIGINT) AS travel, max(travel) AS longest FROM moved GROUP BY session_id""")
def cursor_travel(spark, sf_dir):
    travel = F.abs(F.col("k") - F.lag("k").over(S.ordered("session_id", ORDER)))
    return event_log(spark, sf_dir).select("session_id", travel.alias("t")).groupBy("session_id").agg(F.sum("t").alias("travel"), F.max("t").alias("longest"))


@book.query(f"""WITH {LOG_SQL}, opened AS (
  SELECT *, sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS lifecycle FROM log
), ended AS (
  SELECT *, min(CASE WHEN kind = 'purchase' THEN seq END) OVER (PARTITION BY session_id, lifecycle) AS e FROM opened WHERE lifecycle > 0)
SELECT session_id, CAST(lifecycle AS BIGINT) AS lifecycle, CASE WHEN max(e) IS NOT NULL THEN (max(at_us) - min(at_us)) // 1000 END AS duration_ms,
       count(*) - 1 - count(*) FILTER (WHERE kind = 'purchase') AS n_between, max(e) IS NULL AS left_open
FROM ended WHERE e IS NULL OR seq <= e GROUP BY session_id, lifecycle""")
def composition_lifecycles(spark, sf_dir):
    return S.lifecycles(event_log(spark, sf_dir), "session_id", ORDER, "kind", "view", "purchase", "at_us")


@book.query("""WITH runs AS (
  SELECT *, sum(CASE WHEN role IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run
  FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations))
SELECT conv_id, turn, max(turn % 3 = 0) OVER (PARTITION BY conv_id, run ORDER BY turn ROWS UNBOUNDED PRECEDING) AS handled FROM runs""")
def response_propagation(spark, sf_dir):
    return S.propagate(turn_log(spark, sf_dir), "conv_id", ["turn"], "role", F.col("turn") % 3 == 0).select("conv_id", "turn", "handled")


@book.query(f"""WITH {LOG_SQL}, dt AS (SELECT *, coalesce((at_us - lag(at_us) OVER (PARTITION BY session_id ORDER BY seq)) // 1000, 0) AS dt_ms FROM log),
clocked AS (SELECT *, CAST(sum(dt_ms) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS elapsed_ms FROM dt)
SELECT session_id, seq, elapsed_ms, elapsed_ms - k AS due_ms FROM clocked WHERE kind = 'click'""")
def visible_clock_due_times(spark, sf_dir):
    log = S.clock(S.elapsed(event_log(spark, sf_dir), "session_id", ORDER, "at_us"), "session_id", ORDER, "dt_ms")
    return log.where("kind = 'click'").select("session_id", "seq", "elapsed_ms", (F.col("elapsed_ms") - F.col("k")).alias("due_ms"))


@book.query("""SELECT * FROM (SELECT conv_id, turn, CAST(sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS tail_cost FROM conversations)
WHERE tail_cost <= 400""")
def newest_tail_within_budget(spark, sf_dir):
    cost = F.floor((F.octet_length("text") + 3) / 4).cast("long")
    return S.newest_within(turn_log(spark, sf_dir), "conv_id", ["turn"], cost, 400).select("conv_id", "turn", "tail_cost")


@book.query("""SELECT * FROM (SELECT o_custkey AS session_id, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders)
WHERE step <> 1""")
def contiguity_breaks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey")
    return S.breaks(orders, "session_id", ["o_orderkey"], "o_orderkey")


@book.query(f"""WITH {BURST_SQL}, spread AS (
  SELECT *, min(at_us) OVER (PARTITION BY session_id) AS s, max(at_us) OVER (PARTITION BY session_id) AS e FROM bursts
), cuts AS (SELECT session_id, seq, f AS fraction, abs(at_us - s - CAST(floor(f * (e - s)) AS BIGINT)) AS d FROM spread, (VALUES (0.6::DOUBLE), (0.8::DOUBLE)) v(f) WHERE gap IS NULL OR gap >= {HOUR_US})
SELECT session_id, fraction, seq FROM cuts QUALIFY row_number() OVER (PARTITION BY session_id, fraction ORDER BY d, seq) = 1""")
def split_boundaries(spark, sf_dir):
    gap = F.col("at_us") - F.lag("at_us").over(S.ordered("session_id", ORDER))
    log = event_log(spark, sf_dir).withColumn("starts", gap.isNull() | (gap >= HOUR_US))
    return S.split_at(log, "session_id", ORDER, "at_us", (0.6, 0.8), F.col("starts"))


@book.query("""SELECT o_custkey, o_orderkey, place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders) WHERE place = o_custkey % 3 + 1""")
def ordinal_resolution(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("wanted", F.col("o_custkey") % 3 + 1)
    return S.nth_match(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "wanted").select("o_custkey", "o_orderkey", "place")


@book.query("""SELECT p_partkey, ['drafting', 'revising', 'copying'][(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 3 + 1] AS label FROM part""")
def round_robin_regimes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return S.round_robin(parts, ["p_brand"], ["p_partkey"], ("drafting", "revising", "copying")).select("p_partkey", "label")
