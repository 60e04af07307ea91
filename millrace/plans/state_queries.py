"""Named queries over state: coalescing, timers, ledgers, rules, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.money import tokens
from millrace.operators import spread
from millrace.operators import state as S
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log, turn_log
from millrace.session import table

book = Book()


@book.query(f"""WITH {LOG_SQL}, p AS (SELECT *, coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS interval FROM log)
SELECT session_id, CAST(interval AS BIGINT) AS interval, kind, max(seq) AS seq, CASE WHEN kind = 'click' THEN CAST(sum(k) + count(*) - 1 AS BIGINT) END AS missed FROM p WHERE kind <> 'purchase'
GROUP BY session_id, interval, kind, CASE WHEN kind = 'view' THEN '' WHEN kind = 'click' THEN 't' || k % 3 ELSE 'e' || seq END""")
def coalesced_pending(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("timer", F.col("k") % 3)
    return S.coalesce_pending(log, "session_id", "seq", "kind", "purchase", "view", "click", "timer", "k")


@book.query(f"""WITH {LOG_SQL}, f AS (SELECT *, lag(seq) OVER w AS ps, lag(value > 100) OVER w AS pc FROM log WHERE kind = 'click' WINDOW w AS (PARTITION BY session_id, k % 5 ORDER BY seq))
SELECT session_id, seq, CASE WHEN NOT pc THEN ps END AS supersedes FROM f""")
def superseded_same_key_events(spark, sf_dir):
    fires = event_log(spark, sf_dir).where("kind = 'click'").withColumn("timer", F.col("k") % 5)
    return S.superseded(fires, "session_id", "seq", "timer", F.col("value") > 100).select("session_id", "seq", "supersedes")


@book.query(f"""WITH {LOG_SQL}, t AS (SELECT event_id, at_us // 1000 AS anchor, (k + 1) * 60000 AS interval, k % 4 AS fire_count FROM log WHERE kind = 'signup'),
c AS (SELECT *, (1706745600000 - anchor) // interval AS fires FROM t)
SELECT event_id, fires, fires - fire_count - 1 AS missed, 1706745600000 - (anchor + fires * interval) AS late_ms, anchor + (fires + 1) * interval AS next_due FROM c WHERE fires > fire_count""")
def fixed_rate_timer_claims(spark, sf_dir):
    timers = event_log(spark, sf_dir).where("kind = 'signup'").select(
        "event_id", F.floor(F.col("at_us") / 1000).alias("anchor"), ((F.col("k") + 1) * 60_000).alias("interval"), (F.col("k") % 4).alias("fire_count")
    )
    now = F.lit(1_706_745_600_000)
    return S.claim_timers(timers, now, "anchor", "interval", "fire_count").select("event_id", "fires", "missed", "late_ms", "next_due")


@book.query(f"""WITH {LOG_SQL}, t AS (SELECT session_id, k % 7 AS item, min_by(kind, seq) FILTER (WHERE kind IN ('purchase', 'error')) AS s, min(seq) FILTER (WHERE kind IN ('purchase', 'error')) AS by_seq, count(*) FILTER (WHERE kind IN ('purchase', 'error')) AS n FROM log GROUP BY ALL)
SELECT session_id, item, coalesce(s, 'open') AS state, by_seq, n > 1 AS repeated FROM t""")
def disposition_ledger(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("item", F.col("k") % 7)
    return S.ledger(log, ["session_id", "item"], "seq", F.col("kind").isin("purchase", "error"), "kind")


@book.query(f"""WITH {LOG_SQL}, s AS (SELECT *, coalesce(sum(CASE kind WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM log)
SELECT session_id, seq, CAST(t - least(0, min(t) OVER (PARTITION BY session_id ORDER BY seq)) AS BIGINT) AS active FROM s""")
def active_timers_before(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return S.active_before(log, "session_id", "seq", F.col("kind") == "signup", F.col("kind") == "purchase").select("session_id", "seq", F.col("active").cast("long").alias("active"))


_RULES = {
    "malformed_action": "o_orderpriority = '5-LOW'", "unknown_reference": "c_custkey IS NULL", "payload_limit_exceeded": "o_totalprice > 400000",
    "floor_owned": "c_mktsegment = 'BUILDING'", "timer_limit_exceeded": "c_acctbal < 0", "stale_decision": "o_orderstatus = 'P'",
}
_RULES_SQL = f"""WITH r AS (SELECT o_orderkey, list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _RULES.items())}], lambda x: x IS NOT NULL) AS all_blocks
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 10 <> 3)"""


def _ruled(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return S.blocks(rows, {code: F.expr(rule) for code, rule in _RULES.items()})


@book.query(_RULES_SQL + " SELECT o_orderkey, all_blocks[1] AS first_block FROM r")
def rule_first_block(spark, sf_dir):
    return _ruled(spark, sf_dir).select("o_orderkey", "first_block")


@book.query(_RULES_SQL + " SELECT o_orderkey, array_to_string(all_blocks, '+') AS all_blocks FROM r")
def rule_all_blocks(spark, sf_dir):
    return _ruled(spark, sf_dir).select("o_orderkey", F.array_join("all_blocks", "+").alias("all_blocks"))


@book.query(f"""WITH {LOG_SQL}, c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND k % 2 IS NOT DISTINCT FROM lag(k % 2) OVER w THEN 0 ELSE 1 END AS ch FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, CAST(sum(ch) OVER (PARTITION BY session_id ORDER BY seq) - 1 AS BIGINT) AS state_id FROM c""")
def decision_compression(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("odd", F.col("k") % 2)
    return S.compress(log, "session_id", "seq", ["kind", "odd"]).select("session_id", "seq", "state_id")


@book.query(f"""WITH {LOG_SQL} SELECT session_id, seq, last_value(CASE WHEN kind = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS shown FROM log""")
def decision_decompression(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("shown", F.when(F.col("kind") == "view", F.col("k")))
    return S.carry_forward(log, "session_id", "seq", "shown").select("session_id", "seq", "shown")


_ALLOWED = {"signup": ("view", "click"), "view": ("click", "purchase", "error"), "click": ("view", "purchase"), "purchase": ("signup",), "error": ("view",)}
_LEGAL = " OR ".join(f"(before = '{a}' AND kind IN ({', '.join(repr(b) for b in bs)}))" for a, bs in _ALLOWED.items())


@book.query(f"""WITH {LOG_SQL}, b AS (SELECT *, lag(kind) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM log) SELECT session_id, seq, before, kind FROM b WHERE before IS NOT NULL AND NOT ({_LEGAL})""")
def need_lifecycle_errors(spark, sf_dir):
    return S.lifecycle_errors(event_log(spark, sf_dir), ["session_id"], "seq", "kind", _ALLOWED).select("session_id", "seq", "before", "kind")


@book.query(f"""WITH {LOG_SQL} SELECT session_id, count(*) AS n_events, max(seq) AS last_seq, arg_max(kind, seq) AS last_kind, count(*) FILTER (WHERE kind = 'error') AS n_errors FROM log GROUP BY session_id""")
def final_ledger(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last_seq"), F.max_by("kind", "seq").alias("last_kind"), F.count_if(F.col("kind") == "error").alias("n_errors")
    )


@book.query(f"""WITH RECURSIVE {LOG_SQL}, r AS (
  SELECT session_id, seq, 0::BIGINT AS segment_index, k + 20 AS held FROM log WHERE seq = 0
  UNION ALL
  SELECT l.session_id, l.seq, CASE WHEN r.held >= 500 THEN r.segment_index + 1 ELSE r.segment_index END, CASE WHEN r.held >= 500 THEN 50 ELSE r.held END + l.k + 20
  FROM r JOIN log l ON l.session_id = r.session_id AND l.seq = r.seq + 1)
SELECT session_id, seq, segment_index, held FROM r""")
def rollover_segments(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("size", F.col("k") + 20)
    return S.fold(log, "session_id", ["seq"], ["seq", "size"], S.rollover(500, 50), "session_id long, seq long, segment_index long, held long")


@book.query("""WITH RECURSIVE i AS (SELECT source, doc_id, strlen(text) AS b, (strlen(text) + 3) // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), r AS (
  SELECT source, doc_id, n, 0::BIGINT AS shard, 1::BIGINT AS n_items, b AS n_bytes, t AS n_tokens FROM i WHERE n = 1
  UNION ALL
  SELECT i.source, i.doc_id, i.n, CASE WHEN f THEN shard + 1 ELSE shard END, CASE WHEN f THEN 1 ELSE n_items + 1 END, CASE WHEN f THEN i.b ELSE n_bytes + i.b END, CASE WHEN f THEN i.t ELSE n_tokens + i.t END
  FROM (SELECT r.*, i.n AS n2, r.n_items + 1 > 12 OR r.n_bytes + i.b > 20000 OR r.n_tokens + i.t > 4500 AS f FROM r JOIN i ON i.source = r.source AND i.n = r.n + 1) x JOIN i ON i.source = x.source AND i.n = x.n2)
SELECT source, doc_id, shard, n_items, n_bytes, n_tokens FROM r""")
def shard_packing(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.lit(1).cast("long").alias("items"), F.octet_length("text").cast("long").alias("bytes"), tokens(F.col("text")).alias("tokens")
    )
    packs = spread.packed(items, "source", ["doc_id"], {"items": 12, "bytes": 20_000, "tokens": 4_500})
    return packs.select("source", "doc_id", "shard", *(F.col(f"held_{c}").alias(f"n_{c}") for c in ("items", "bytes", "tokens")))


_SAMPLED = """x AS (SELECT *, lead(at_us) OVER (PARTITION BY session_id ORDER BY seq) AS next_at FROM log),
r AS (SELECT *, next_at IS NULL OR next_at - at_us >= 43200000000 AS rests, CASE WHEN kind IN ('click', 'purchase') THEN k END AS hint FROM x),
n AS (SELECT *, least((SELECT min(b.seq) FROM log b WHERE b.session_id = r.session_id AND b.at_us >= r.at_us + 14400000000),
  (SELECT min(b.seq) + 1 FROM r b WHERE b.session_id = r.session_id AND b.seq >= r.seq AND b.rests AND b.next_at IS NOT NULL)) AS following FROM r WHERE seq > 0)"""


@book.query(f"""WITH RECURSIVE {LOG_SQL}, {_SAMPLED}, w AS (
  SELECT session_id, 0::BIGINT AS "window", seq, following FROM n WHERE seq = 1
  UNION ALL SELECT n.session_id, w."window" + 1, n.seq, n.following FROM w JOIN n ON n.session_id = w.session_id AND n.seq = w.following),
p AS (SELECT r.session_id, r.seq, r.at_us, r.rests, r.hint, coalesce(max(w."window"), -1) AS "window" FROM r LEFT JOIN w ON w.session_id = r.session_id AND w.seq <= r.seq GROUP BY ALL)
SELECT session_id, 'active' AS activity, "window", min(seq) AS first_seq, max(seq) AS last_seq,
  CASE WHEN "window" < 0 THEN min(at_us) ELSE least(min(at_us) + 14400000000, max(at_us) + 43200000000) END AS emitted,
  CASE WHEN "window" >= 0 THEN arg_max(hint, seq) FILTER (WHERE hint IS NOT NULL) END AS hint FROM p GROUP BY session_id, "window"
UNION ALL SELECT session_id, 'paused', "window", seq, seq, at_us + 43200000000, NULL FROM p WHERE rests""")
def sampler_windows(spark, sf_dir):
    """A trailing throttle of four hours and one paused frame after twelve, over each user's events as activities."""
    hour = 3_600_000_000
    log = event_log(spark, sf_dir).withColumn("hint", F.when(F.col("kind").isin("click", "purchase"), F.col("k")))
    return spread.sampled(log, "session_id", ["at_us", "seq"], "at_us", 4 * hour, 12 * hour, "hint")


@book.query()
def reduce_stream_fold(spark, sf_dir):
    schema = "session_id long, seq long, view long, n_timers long, pending long"
    return S.fold(event_log(spark, sf_dir), "session_id", ["seq"], ["seq", "kind", "k"], S.reduce_visible, schema)


@book.query()
def span_projection(spark, sf_dir):
    turns = turn_log(spark, sf_dir)
    return S.fold(turns, "conv_id", ["turn"], ["turn", "text"], S.follow_span(), "conv_id long, turn long, start long, end long")


@book.query()
def ambiguous_targets(spark, sf_dir):
    """Six revisions of each conversation's first text, and where its second word may stand in each."""
    first = turn_log(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    half = F.floor(F.char_length("t") / 2).cast("int")
    revisions = (
        F.col("t"), F.concat(F.lit("Oh, "), "t"), F.concat("t", F.lit(" "), "t"), F.concat("t", F.lit(" and "), "t"),
        F.concat(F.substring("t", F.lit(2), half), F.lit(" "), "t"), F.substring("t", F.lit(1), half),
    )
    log = first.select("conv_id", F.posexplode(F.array(*revisions)).alias("revision", "text"))
    return S.fold(log, "conv_id", ["revision"], ["revision", "text"], S.follow_ambiguous(1), "conv_id long, revision int, touched boolean, starts array<bigint>")
