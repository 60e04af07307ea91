"""Named queries over live streams, each equal to a batch query over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log
from millrace.session import shared_folder
from millrace.streaming import lanes, ledger
from millrace.streaming.running import read_files, to_the_end

book = Book()

HOUR = 3_600_000


@book.query(f"""WITH RECURSIVE {LOG_SQL}, c AS (SELECT session_id, seq, at_us // 1000 AS tm, kind, k FROM log), h AS (SELECT max(tm) + 1 AS last FROM c),
s AS (SELECT session_id, 't' || k % 5 AS name, (k % 5 + 1) * {6 * HOUR} AS every, tm, seq, row_number() OVER (PARTITION BY session_id, k % 5 ORDER BY tm, seq) AS nth FROM c WHERE kind = 'signup'),
t AS (SELECT s.session_id, s.name, any_value(s.every) AS every, any_value(s.tm) AS tm, min(struct_pack(tm := c.tm, seq := c.seq)) AS ended
  FROM s LEFT JOIN c ON c.session_id = s.session_id AND (c.tm, c.seq) > (s.tm, s.seq) AND (c.kind = 'purchase' OR c.kind = 'view' AND 't' || c.k % 5 = s.name) WHERE nth = 1 GROUP BY s.session_id, s.name),
q AS (SELECT session_id, 'r' || k % 3 AS name, tm, seq, tm + (k % 7 + 1) * {HOUR} AS due, row_number() OVER (PARTITION BY session_id, k % 3 ORDER BY tm, seq) AS nth FROM c WHERE kind = 'click'),
a AS (SELECT session_id, name, tm, seq, due, nth FROM q WHERE nth = 1
  UNION ALL SELECT q.session_id, q.name, q.tm, q.seq, q.due, q.nth FROM a JOIN q ON q.session_id = a.session_id AND q.name = a.name
  AND q.nth = (SELECT min(x.nth) FROM q x WHERE x.session_id = a.session_id AND x.name = a.name AND x.nth > a.nth AND x.tm >= a.due))
SELECT session_id, tm AS at_ms, CASE nth WHEN 1 THEN 'scheduled' ELSE 'already_scheduled' END AS what, name, NULL::BIGINT AS n, seq FROM s
UNION ALL SELECT session_id, tm + i * every, 'fire', name, i, NULL FROM (SELECT t.*, unnest(range(1, ((least(last, coalesce(ended.tm, last)) - tm) // every + 1)::BIGINT)) AS i FROM t, h)
UNION ALL SELECT session_id, ended.tm, 'canceled', name, NULL, ended.seq FROM t WHERE ended IS NOT NULL AND ended.tm IS NOT NULL
UNION ALL SELECT c.session_id, c.tm, 'not_active', 't' || k % 5, NULL, c.seq FROM c LEFT JOIN t ON t.session_id = c.session_id AND t.ended.seq = c.seq WHERE c.kind = 'view' AND t.name IS NULL
UNION ALL SELECT q.session_id, q.tm, CASE WHEN a.seq IS NULL THEN 'already_pending' ELSE 'requested' END, q.name, NULL, q.seq FROM q LEFT JOIN a ON a.session_id = q.session_id AND a.seq = q.seq
UNION ALL SELECT session_id, due, 'result', name, NULL, NULL FROM a, h WHERE due <= last""")
def streamed_ledger(spark, sf_dir):
    """Each user's events as commands of a live ledger: signups schedule, views cancel one timer, purchases all, clicks ask for results."""
    kind = F.element_at(F.create_map(*map(F.lit, ("signup", "schedule", "view", "cancel", "purchase", "cancel_all", "click", "request"))), F.col("kind"))
    timer, k = F.concat(F.lit("t"), (F.col("k") % 5).cast("string")), F.col("k")
    commands = event_log(spark, sf_dir).where("kind <> 'error'").select(
        "session_id", F.floor(F.col("at_us") / 1000).cast("long").alias("at_ms"), "seq", kind.alias("kind"),
        F.when(F.col("kind") == "signup", timer).when(F.col("kind") == "click", F.concat(F.lit("r"), (k % 3).cast("string"))).alias("name"),
        F.when(F.col("kind") == "signup", (k % 5 + 1) * 6 * HOUR).when(F.col("kind") == "click", (k % 7 + 1) * HOUR).alias("amount"),
        F.when(F.col("kind") == "view", timer).alias("names"),
    )
    last = event_log(spark, sf_dir).agg(F.floor(F.max("at_us") / 1000)).first()[0] or 0
    rows = read_files(spark, written(commands))
    return to_the_end(spark, rows, "at_ms", last + 2, ledger.live).where("session_id IS NOT NULL")


def written(df: DataFrame) -> str:
    """``df`` as Parquet in the shared folder, from where a stream can read it."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


_LINES = """CASE event_id % 10 WHEN 3 THEN '{oops' WHEN 4 THEN '{"user_id": ' || user_id || '}' WHEN 5 THEN '{"user_id": "u' || user_id || '", "kind": "' || event_type || '"}' WHEN 6 THEN '[1]'
WHEN 7 THEN '{"user_id": null, "kind": "x"}' ELSE '{"user_id": ' || user_id || ', "kind": "' || event_type || '"}' END"""


@book.query("""SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'malformed_json' WHEN 6 THEN 'malformed_json' WHEN 4 THEN 'missing_field' WHEN 7 THEN 'missing_field' WHEN 5 THEN 'wrong_type' END AS reason,
CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6, 7) THEN user_id END AS user_id, CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6, 7) THEN event_type END AS kind FROM events""")
def rejected_ingress(spark, sf_dir):
    """Events as lines of JSON, five of ten of them broken in some way, through the two lanes of a stream."""
    lines = read_files(spark, f"{sf_dir}/events.parquet").select("event_id", F.expr(_LINES).alias("line"))
    accepted, rejected = lanes.split(spark, lines, "line", {"user_id": "bigint", "kind": "string"})
    good = accepted.select("event_id", F.lit(None).cast("string").alias("reason"), "parsed.user_id", "parsed.kind")
    return good.unionByName(rejected.select("event_id", "reason"), allowMissingColumns=True)
