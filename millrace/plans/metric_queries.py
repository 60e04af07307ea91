"""Named queries over metrics of input, frames and decisions, and over set and selection operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.operators import trees
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log, turn_log
from millrace.plans.policy import POLICY_SQL, policy_log
from millrace.plans.scalar_queries import book as scalar_book
from millrace.plans.scalar_queries import turn_edit_kind
from millrace.session import table

book = Book()


@book.query("""WITH e AS (SELECT user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT session_id, count(*) FILTER (WHERE k % 10 = 0) AS pastes, count(*) AS inputs, CAST(sum(k) FILTER (WHERE k % 10 = 0) AS BIGINT) AS pasted_chars,
  count(*) FILTER (WHERE k % 10 = 0) / count(*) AS paste_rate, count(*) FILTER (WHERE k % 10 = 0) > 0 AS paste_seen FROM e GROUP BY session_id""")
def paste_metrics(spark, sf_dir):
    k = F.col("k")
    inputs = event_log(spark, sf_dir).select("session_id", F.when(k % 10 == 0, "insertFromPaste").otherwise("insertText").alias("input_type"), F.repeat(F.lit("x"), k.cast("int")).alias("data"))
    return M.paste(inputs, "session_id", "input_type", "data")


#: Turns read as frames of a sampler.
_FRAMES_SQL = """frames AS (SELECT conv_id, turn, turn * turn * 130 AS at_ms, text, least(length(text), turn * 11) AS cursor,
  least(length(text), turn * 11 + turn % 3) AS cursor_end, turn % 3 = 0 AS composing, turn % 2 = 0 AS active FROM conversations)"""


def _frames(spark, sf_dir):
    turn, size = F.col("turn"), F.char_length("text")
    return turn_log(spark, sf_dir).select(
        "conv_id", "turn", (turn * turn * 130).alias("at_ms"), "text", F.least(size, turn * 11).alias("cursor"),
        F.least(size, turn * 11 + turn % 3).alias("cursor_end"), (turn % 3 == 0).alias("composing"), (turn % 2 == 0).alias("active"),
    )


_SUMMARY = "SELECT metric, count(value) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM u GROUP BY metric"
_CHANGED = "c AS (SELECT *, lag(at_ms) OVER w AS pa, lag(text) OVER w AS pt, lag(cursor) OVER w AS pc FROM frames WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@book.query(f"""WITH {_FRAMES_SQL}, {_CHANGED}, u AS (SELECT 'snapshot_dt_ms' AS metric, CAST(at_ms - pa AS DOUBLE) AS value FROM c WHERE pa IS NOT NULL
UNION ALL SELECT 'text_length_delta_chars', length(text) - length(pt) FROM c WHERE pa IS NOT NULL UNION ALL SELECT 'cursor_distance_utf16', abs(cursor - pc) FROM c WHERE pa IS NOT NULL
UNION ALL SELECT 'unchanged_snapshot_rate', CASE WHEN text = pt THEN 1 ELSE 0 END FROM c WHERE pa IS NOT NULL) {_SUMMARY}""")
def sampler_metrics(spark, sf_dir):
    changed = M.sampled_changes(_frames(spark, sf_dir), "conv_id", ["turn"], "at_ms", "text", "cursor")
    names = ("snapshot_dt_ms", "text_length_delta_chars", "cursor_distance_utf16")
    values = {n: F.col(n) for n in names} | {"unchanged_snapshot_rate": F.col("unchanged").cast("int")}
    return A.summary(M.values_of(changed, values), ["metric"], "value")


_EDITS = ("insert", "delete", "replace", "paste", "cursor_move", "none")


@book.query(f"""WITH e AS ({scalar_book.sql['turn_edit_kind']}), k AS (SELECT unnest([{', '.join(repr(k) for k in _EDITS)}]) AS kind)
SELECT 'edit_' || kind || '_rate' AS metric, (SELECT count(*) FROM e WHERE edit = kind) AS num, (SELECT count(*) FROM e) AS den, round((SELECT count(*) FROM e WHERE edit = kind) / (SELECT count(*) FROM e), 6) AS rate FROM k""")
def sampler_edit_rates(spark, sf_dir):
    always = F.lit(True)
    return M.rates_of(turn_edit_kind(spark, sf_dir), {f"edit_{k}_rate": (F.col("edit") == k, always) for k in _EDITS})


@book.query(f"""WITH {_FRAMES_SQL}, a AS (SELECT *, lag(active) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM frames),
u AS (SELECT 'active_rate' AS metric, count(*) FILTER (WHERE active) AS num, count(*) AS den FROM a UNION ALL SELECT 'composing_rate', count(*) FILTER (WHERE composing), count(*) FROM a
UNION ALL SELECT 'active_to_paused_rate', count(*) FILTER (WHERE before AND NOT active), count(before) FROM a UNION ALL SELECT 'paused_to_active_rate', count(*) FILTER (WHERE NOT before AND active), count(before) FROM a
UNION ALL SELECT 'active_to_active_rate', count(*) FILTER (WHERE before AND active), count(before) FROM a UNION ALL SELECT 'paused_to_paused_rate', count(*) FILTER (WHERE NOT before AND NOT active), count(before) FROM a)
SELECT metric, num, den, CASE WHEN den > 0 THEN round(num / den, 6) END AS rate FROM u""")
def sampler_activity_rates(spark, sf_dir):
    before = F.lag("active").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _frames(spark, sf_dir).withColumn("before", before)
    active, was, known, always = F.col("active"), F.col("before"), F.col("before").isNotNull(), F.lit(True)
    return M.rates_of(rows, {
        "active_rate": (active, always), "composing_rate": (F.col("composing"), always), "active_to_paused_rate": (was & ~active, known),
        "paused_to_active_rate": (~was & active, known), "active_to_active_rate": (was & active, known), "paused_to_paused_rate": (~was & ~active, known),
    })


@book.query(f"""WITH {_FRAMES_SQL}, {LOG_SQL}, v AS (SELECT session_id, seq, lag(seq, 1, -1) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM log WHERE kind = 'view'),
u AS (SELECT 'cursor_position_utf16' AS metric, CAST(cursor AS DOUBLE) AS value FROM frames UNION ALL SELECT 'selection_length_utf16', cursor_end - cursor FROM frames
UNION ALL SELECT 'raw_input_changes_per_snapshot', seq - before - 1 FROM v) {_SUMMARY}""")
def sampler_position_metrics(spark, sf_dir):
    frames = M.values_of(_frames(spark, sf_dir), {"cursor_position_utf16": F.col("cursor"), "selection_length_utf16": F.col("cursor_end") - F.col("cursor")})
    log = event_log(spark, sf_dir).select("session_id", "seq", "kind")
    between = J.count_between(log.where("kind = 'view'"), log.where("kind <> 'view'"), "session_id", "seq")
    return A.summary(frames.unionByName(M.values_of(between, {"raw_input_changes_per_snapshot": F.col("n_between")})), ["metric"], "value")


#: A decision ends k seconds after it starts.
_ARRIVED = f"""{LOG_SQL}, ends AS (SELECT *, coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER w, 0) AS decision,
  last_value(CASE WHEN kind = 'purchase' THEN at_us + k * 1000000 END IGNORE NULLS) OVER w AS ended FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), placed AS (SELECT *, coalesce(at_us < ended, false) AS busy, max(CASE WHEN kind = 'view' THEN seq END) OVER d AS last, max(CASE WHEN kind = 'purchase' THEN at_us END) OVER d AS decided_at
  FROM ends WINDOW d AS (PARTITION BY session_id, decision)
), arrived AS (SELECT session_id, seq, kind, CAST(decision AS BIGINT) AS decision, busy, coalesce(kind = 'view' AND seq < last, false) AS replaced, at_us, decided_at FROM placed WHERE kind <> 'purchase' AND decided_at IS NOT NULL)"""


def _arrived(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("finished", F.col("at_us") + F.col("k") * 1_000_000)
    return M.arrivals(log, "session_id", "seq", "at_us", "kind", "purchase", "finished", "view")


@book.query(f"WITH {_ARRIVED} SELECT session_id, seq, kind, decision, busy, replaced FROM arrived")
def arrival_audit(spark, sf_dir):
    return _arrived(spark, sf_dir).select("session_id", "seq", "kind", "decision", "busy", F.coalesce("replaced", F.lit(False)).alias("replaced"))


@book.query(f"""WITH {_ARRIVED}, p AS (SELECT session_id, decision, count(*) AS n, count(*) FILTER (WHERE kind = 'view') AS views FROM arrived GROUP BY ALL),
u AS (SELECT 'pending_snapshot_replacement_rate' AS metric, count(*) FILTER (WHERE replaced) AS num, count(*) FILTER (WHERE kind = 'view') AS den FROM arrived
UNION ALL SELECT 'busy_snapshot_coalescing_rate', count(*) FILTER (WHERE kind = 'view' AND busy AND replaced), count(*) FILTER (WHERE kind = 'view' AND busy) FROM arrived
UNION ALL SELECT 'arrivals_during_busy_rate', count(*) FILTER (WHERE busy), count(*) FROM arrived UNION ALL SELECT 'timer_arrival_during_busy_rate', count(*) FILTER (WHERE kind = 'click' AND busy), count(*) FILTER (WHERE kind = 'click') FROM arrived
UNION ALL SELECT 'tool_arrival_during_busy_rate', count(*) FILTER (WHERE kind = 'error' AND busy), count(*) FILTER (WHERE kind = 'error') FROM arrived
UNION ALL SELECT 'non_user_wake_rate', count(*) FILTER (WHERE views = 0), count(*) FROM p UNION ALL SELECT 'event_contention_rate', count(*) FILTER (WHERE n > 1), count(*) FROM p)
SELECT metric, num, den, CASE WHEN den > 0 THEN round(num / den, 6) END AS rate FROM u""")
def policy_rates(spark, sf_dir):
    arrived = _arrived(spark, sf_dir)
    kind, busy, always = F.col("kind"), F.col("busy"), F.lit(True)
    of_arrivals = M.rates_of(arrived, {
        "pending_snapshot_replacement_rate": (F.col("replaced"), kind == "view"), "busy_snapshot_coalescing_rate": (F.col("replaced"), (kind == "view") & busy),
        "arrivals_during_busy_rate": (busy, always), "timer_arrival_during_busy_rate": (busy, kind == "click"), "tool_arrival_during_busy_rate": (busy, kind == "error"),
    })
    decisions = arrived.groupBy("session_id", "decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == "view").alias("views"))
    return of_arrivals.unionByName(M.rates_of(decisions, {"non_user_wake_rate": (F.col("views") == 0, always), "event_contention_rate": (F.col("n") > 1, always)}))


@book.query(f"""WITH {_ARRIVED}, u AS (SELECT 'ingress_to_decision_start_ms' AS metric, (decided_at - at_us) / 1000 AS value FROM arrived UNION ALL SELECT 'service_time_ms', k * 1000.0::DOUBLE FROM log WHERE kind = 'purchase') {_SUMMARY}""")
def policy_latency(spark, sf_dir):
    waited = M.values_of(_arrived(spark, sf_dir), {"ingress_to_decision_start_ms": (F.col("decided_at") - F.col("at_us")) / 1000})
    served = M.values_of(event_log(spark, sf_dir).where("kind = 'purchase'"), {"service_time_ms": F.col("k") * 1000})
    return A.summary(waited.unionByName(served), ["metric"], "value")


@book.query(f"""WITH {POLICY_SQL}, d AS (SELECT (SELECT arg_max(e.active, e.seq) FROM ev e WHERE e.kind = 'snapshot' AND e.session_id = a.session_id AND e.seq <= a.observed_seq) AS active FROM act a),
u AS (SELECT 'active_at_decision_rate' AS metric, count(*) FILTER (WHERE active) AS num, count(*) AS den FROM d UNION ALL SELECT 'paused_at_decision_rate', count(*) FILTER (WHERE NOT active), count(*) FROM d
UNION ALL SELECT 'no_snapshot_at_decision_rate', count(*) FILTER (WHERE active IS NULL), count(*) FROM d) SELECT metric, num, den, round(num / den, 6) AS rate FROM u""")
def policy_state_at_decision(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    snapshots = log.events.where("kind = 'snapshot'").select("session_id", "seq", "active")
    decisions = J.as_of(log.actions.select("session_id", "observed_seq"), snapshots, "session_id", "observed_seq", "seq", ["active"])
    active, always = F.col("as_of_active"), F.lit(True)
    return M.rates_of(decisions, {"active_at_decision_rate": (active, always), "paused_at_decision_rate": (~active, always), "no_snapshot_at_decision_rate": (active.isNull(), always)})


@book.query(f"""WITH {POLICY_SQL}, l AS (SELECT session_id, seq, 0 AS channel, at_us // 60000000 AS minute FROM ev WHERE kind = 'snapshot' UNION ALL SELECT session_id, seq, 1, at_us // 60000000 FROM act)
SELECT session_id, seq, channel, row_number() OVER (PARTITION BY session_id ORDER BY minute, channel, seq) AS place FROM l""")
def merged_schedule(spark, sf_dir):
    log = policy_log(spark, sf_dir)
    minute = F.floor(F.col("at_us") / 60_000_000).alias("minute")
    lanes = log.events.where("kind = 'snapshot'").select("session_id", "seq", F.lit(0).alias("channel"), minute).unionByName(log.actions.select("session_id", "seq", F.lit(1).alias("channel"), minute))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("minute", "channel", "seq"))
    return lanes.select("session_id", "seq", "channel", place.cast("long").alias("place"))


_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"


@book.query(f"""WITH w AS (SELECT source, lang, list_distinct(flatten(list({_TOKENS}))) AS words FROM documents GROUP BY ALL), i AS (SELECT item_id, {_TOKENS} AS asked FROM benchmark)
SELECT w.source, w.lang, count(*) FILTER (WHERE len(list_filter(asked, lambda x: NOT list_contains(words, x))) = 0) AS covered, count(*) AS items FROM w, i GROUP BY ALL""")
def vocabulary_subset_test(spark, sf_dir):
    held_words = table(spark, sf_dir, "documents").select("source", "lang", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    size = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    held = held_words.join(asked, "word").groupBy("source", "lang", "item_id").agg(F.count(F.lit(1)).alias("n")).join(size, "item_id")
    groups = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    covered = held.groupBy("source", "lang").agg(F.count_if(F.col("n") == F.col("size")).alias("covered"))
    items = F.lit(table(spark, sf_dir, "benchmark").count()).cast("long")
    return groups.join(covered, ["source", "lang"], "left").fillna(0, ["covered"]).withColumn("items", items)


@book.query(f"WITH {LOG_SQL}, f AS (SELECT session_id, kind, min(seq) AS first FROM log GROUP BY ALL) SELECT session_id, list(kind ORDER BY first) AS kinds FROM f GROUP BY session_id")
def distinct_in_order(spark, sf_dir):
    first = event_log(spark, sf_dir).groupBy("session_id", "kind").agg(F.min("seq").alias("first"))
    kinds = F.array_sort(F.collect_list(F.struct("first", "kind")))
    return first.groupBy("session_id").agg(F.transform(kinds, lambda x: x["kind"]).alias("kinds"))


@book.query("""WITH a AS (SELECT doc_id, source, lang, sha256(text) AS content, n_chars > 300 AS long FROM documents),
r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS reviewed, quality = 1 AS approved FROM documents d JOIN labels USING (doc_id))
SELECT a.doc_id, lang, coalesce(approved AND reviewed = content, false) AS approved FROM a LEFT JOIN r USING (doc_id) WHERE lang IN ('en', 'de') AND long""")
def current_review_selection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", F.sha2("text", 256))
    reviewed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content"))
    reviews = docs.select("doc_id", reviewed.alias("content")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id")
    pool = docs.where(F.col("lang").isin("en", "de") & (F.col("n_chars") > 300)).select("doc_id", "lang", "content")
    return pool.join(reviews, ["doc_id", "content"], "left").select("doc_id", "lang", F.coalesce("ok", F.lit(False)).alias("approved"))


@book.query("""WITH asked AS (SELECT l_orderkey AS bundle, l_partkey AS id FROM lineitem GROUP BY ALL), n AS (SELECT bundle, count(*) AS wanted, count(p.p_partkey) AS found FROM asked LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) p ON id = p.p_partkey GROUP BY bundle)
SELECT bundle, wanted, found = wanted AS complete FROM n""")
def bundle_all_or_nothing(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle"), F.col("l_partkey").alias("id")).distinct()
    there = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.lit(1).alias("here"))
    counted = asked.join(there, "id", "left").groupBy("bundle").agg(F.count(F.lit(1)).alias("wanted"), F.count("here").alias("found"))
    return counted.select("bundle", "wanted", (F.col("found") == F.col("wanted")).alias("complete"))


#: Fixed values of the cancellation grammar.
_ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
_CANCEL = r"^Cancel the ([a-z]+) active ([a-z]+(?:-[a-z]+)*) reminder\.$"
_UTTERANCE = "CASE WHEN o_orderkey % 7 = 0 THEN 'Cancel it' ELSE 'Cancel the ' || [{0}, 'last'][o_orderkey % 11 + 1] || ' active ' || ['tea', 'slow-cooker', 'oven'][o_orderkey % 3 + 1] || ' reminder.' END".format(", ".join(map(repr, _ORDINALS)))


@book.query(f"""WITH u AS (SELECT o_orderkey, {_UTTERANCE} AS t FROM orders), p AS (SELECT *, list_position([{', '.join(map(repr, _ORDINALS))}], regexp_extract(t, '{_CANCEL}', 1)) AS n FROM u)
SELECT o_orderkey, CAST(nullif(n, 0) AS INTEGER) AS ordinal, CASE WHEN n > 0 THEN replace(regexp_extract(t, '{_CANCEL}', 2), '-', ' ') END AS descriptor FROM p""")
def cancel_grammar(spark, sf_dir):
    key = F.col("o_orderkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    said = F.concat(F.lit("Cancel the "), pick((*_ORDINALS, "last")), F.lit(" active "), pick(("tea", "slow-cooker", "oven")), F.lit(" reminder."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 == 0, "Cancel it").otherwise(said).alias("t"))
    ordinal = F.nullif(F.array_position(F.array(*map(F.lit, _ORDINALS)), F.regexp_extract("t", _CANCEL, 1)).cast("int"), F.lit(0))
    return rows.select("o_orderkey", ordinal.alias("ordinal"), F.when(ordinal.isNotNull(), F.replace(F.regexp_extract("t", _CANCEL, 2), F.lit("-"), F.lit(" "))).alias("descriptor"))


@book.query("""SELECT event_id, list_sort(list_distinct(['e_' || event_id, 'e_' || event_id % 7, 'e_' || event_id % 5])) AS ids FROM events""")
def event_reference_scan(spark, sf_dir):
    """Event ids under keys of theirs at any depth, not those that a text quotes."""
    e = F.col("event_id").cast("string")
    seven, five = ((F.col("event_id") % n).cast("string") for n in (7, 5))
    quoted = r'"note":"\"x_event_id\":\"e_999\"","kinds":["e_998",{"deep":{"fact_event_ids":["e_'
    body = F.concat(F.lit('{"result_event_id":"e_'), e, F.lit('",' + quoted), seven, F.lit('","e_'), five, F.lit('"],"other_event_id":null}}]}'))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("j"))
    return trees.references(trees.paths(rows, ["event_id"], "j"), ["event_id"], "event_id")


_DATA = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '\" \"' WHEN 2 THEN '[null, \"\"]' WHEN 3 THEN '{\"a\": {\"b\": 0}}' WHEN 4 THEN '{oops' ELSE '\"ok ' || event_id || '\"' END"


@book.query("""WITH e AS (SELECT event_id, event_id % 4 = 0 AS failed, event_id % 6 AS m FROM events)
SELECT event_id, CASE WHEN m = 4 OR failed OR m < 3 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN m = 4 THEN 'malformed_result' WHEN failed THEN 'lookup_failed' WHEN m < 3 THEN 'no_usable_data' END AS code FROM e""")
def tool_result_normalisation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4 == 0).alias("failed"), F.expr(_DATA).alias("data"))
    # A usable answer is any number, boolean or text that is not blank, at any depth and not as a key.
    found = trees.usable(trees.paths(rows, ["event_id"], "data"), ["event_id"])
    met = rows.join(found, "event_id", "left")
    malformed = F.col("data").isNotNull() & F.col("usable").isNull()
    code = F.when(malformed, "malformed_result").when(F.col("failed"), "lookup_failed").when(~F.coalesce("usable", F.lit(False)), "no_usable_data")
    return met.select("event_id", F.when(code.isNull(), "succeeded").otherwise("failed").alias("status"), code.alias("code"))


@book.query(f"""WITH {POLICY_SQL}, p AS (SELECT session_id, seq, type, target_seq, reason, lead(type) OVER w AS o_type, lead(target_seq) OVER w AS o_target, lead(reason) OVER w AS o_reason FROM act WHERE type IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, type = o_type AND target_seq = o_target AND (type IN ('integrate', 'respond') OR reason = o_reason) AS same FROM p WHERE o_type IS NOT NULL""")
def action_equivalence(spark, sf_dir):
    from millrace.operators.rules import parsed

    w = Window.partitionBy("session_id").orderBy("seq")
    acts = parsed(policy_log(spark, sf_dir).actions).where("type IS NOT NULL").select("session_id", "seq", "type", "target_seq", "reason")
    pairs = acts.withColumns({f"o_{c}": F.lead(c).over(w) for c in ("type", "target_seq", "reason")}).where("o_type IS NOT NULL")
    wording_counts = ~F.col("type").isin("integrate", "respond")
    same = (F.col("type") == F.col("o_type")) & (F.col("target_seq") == F.col("o_target_seq")) & (~wording_counts | (F.col("reason") == F.col("o_reason")))
    return pairs.select("session_id", "seq", same.alias("same"))


@book.query("""WITH p AS (SELECT p_partkey, regexp_extract_all(hex(encode(p_name)), '..') AS a, regexp_extract_all(hex(encode(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || p_size ELSE replace(p_name, 'a', 'é') END)), '..') AS b FROM part),
d AS (SELECT p_partkey, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]) AS places FROM p)
SELECT p_partkey, len(places) AS differing, CAST(list_min(places) - 1 AS BIGINT) AS first_difference FROM d""")
def byte_difference(spark, sf_dir):
    """Bytes in which two texts differ, those that only the longer one has included, and the place of the first."""
    key, name = F.col("p_partkey") % 3, F.col("p_name")
    other = F.when(key == 0, name).when(key == 1, F.concat(name, F.col("p_size").cast("string"))).otherwise(F.replace(name, F.lit("a"), F.lit("é")))
    bytes_of = lambda text: F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    rows = table(spark, sf_dir, "part").select("p_partkey", bytes_of(name).alias("a"), bytes_of(other).alias("b"))
    differs = rows.select("p_partkey", F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)).alias("d"))
    first = F.array_position("d", F.lit(True)) - 1
    return differs.select("p_partkey", F.size(F.filter("d", lambda x: x)).cast("long").alias("differing"), F.when(first >= 0, first).alias("first_difference"))


@book.query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) AS share FROM c)
SELECT o_orderpriority, o_orderstatus, n, round(share, 6) AS share, abs(share - 1 / 3) <= 0.2 AS near_expected FROM s""")
def kind_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority"))
    return counts.select("o_orderpriority", "o_orderstatus", "n", F.round(share, 6).alias("share"), (F.abs(share - 1 / 3) <= 0.2).alias("near_expected"))


@book.query(f"WITH {LOG_SQL} SELECT session_id, seq, printf('e_%06d', CAST(seq + 1 AS INTEGER)) AS event_name FROM log WHERE kind <> 'error'")
def allocated_ids(spark, sf_dir):
    log = event_log(spark, sf_dir).where("kind <> 'error'")
    return log.select("session_id", "seq", F.format_string("e_%06d", F.col("seq") + 1).alias("event_name"))


@book.query(f"""WITH {LOG_SQL}, g AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS segment FROM log)
SELECT session_id, seq, kind FROM g WHERE segment = 2""")
def policy_segment_scan(spark, sf_dir):
    from millrace.operators import sequence

    log = sequence.segment(event_log(spark, sf_dir), "session_id", ["seq"], F.col("kind") == "error")
    return log.where("segment_index = 2").select("session_id", "seq", "kind")


@book.query(r"""SELECT conv_id, turn, len(list_filter(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-2:], lambda x: regexp_matches(trim(x), '(?i)^(?:can|could|would|will|do|does|did|is|are|was|were|should|may|who|what|when|where|why|how|which)\b.*\?$')
  OR regexp_matches(trim(x), '(?i)^(?:please\s+)?(?:answer|respond|tell|explain|describe|identify|suggest|clarify|recommend|help)\b.*[.?!]$'))) > 0 AS asks
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text ELSE text || chr(10) || ['Can you say why?', 'please  explain it.', 'over to you'][turn % 4] END AS text FROM conversations)""")
def response_requests(spark, sf_dir):
    more = F.element_at(F.array(*map(F.lit, ("Can you say why?", "please  explain it.", "over to you"))), F.greatest(F.col("turn") % 4, F.lit(1)).cast("int"))
    said = F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\n"), more))
    rows = turn_log(spark, sf_dir).withColumn("text", said)
    return rows.select("conv_id", "turn", T.asks_for_response(F.col("text")).alias("asks"))
