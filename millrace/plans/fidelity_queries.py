"""Named queries that hold one account of a session to another: nested states, prompts, and the sets of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators import prefixes as P
from millrace.operators import trees
from millrace.plans.book import Book
from millrace.plans.log import turn_log
from millrace.session import table

book = Book()

#: Two JSON texts for each event: a state, and one that says the same or differs in one way.
_STATE = """'{"seq":' || event_id || ',"timers":[{"id":"t_1","open":true},{"id":"t_' || user_id || '","open":false}],"floor":{"owned":' || (event_id % 3 = 0) || ',"by":null},"note":"say \\"' || event_type || '\\""}'"""
_CHANGED = """CASE event_id % 8
  WHEN 0 THEN '{"note":"say \\"' || event_type || '\\"","floor":{"by":null,"owned":' || (event_id % 3 = 0) || '},"timers":[{"open":true,"id":"t_1"},{"open":false,"id":"t_' || user_id || '"}],"seq":' || event_id || '}'
  WHEN 1 THEN replace(state, '"owned":' || (event_id % 3 = 0), '"owned":"' || (event_id % 3 = 0) || '"')
  WHEN 2 THEN replace(state, ',{"id":"t_' || user_id || '","open":false}', '')
  WHEN 3 THEN replace(state, event_type || '\\"', event_type || '\\" ')
  WHEN 4 THEN replace(state, '"by":null', '"by":"user"')
  WHEN 5 THEN replace(state, '"open":true', '"open":true,"due":{"at":[1,2]}')
  WHEN 6 THEN replace(state, '"seq":' || event_id, '"seq":' || (event_id + 1))
  ELSE replace(state, '"floor":{', '"floor":[],"was":{') END"""
_SIDE = """SELECT event_id, fullkey AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
  CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN atom ->> '$' END AS text FROM s, json_tree(s.{}::JSON)"""


def _spark(sql: str) -> str:
    """The same text expression for Spark, whose literals take a doubled backslash."""
    return sql.replace("\\", "\\\\")


def _states(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return events.withColumn("state", F.expr(_spark(_STATE))).withColumn("changed", F.expr(_spark(_CHANGED)))


@book.query(f"""WITH x AS (SELECT event_id, user_id, event_type, {_STATE} AS state FROM events), s AS MATERIALIZED (SELECT *, {_CHANGED} AS changed FROM x),
e AS MATERIALIZED ({_SIDE.format('state')}), a AS MATERIALIZED ({_SIDE.format('changed')}),
d AS MATERIALIZED (SELECT coalesce(e.event_id, a.event_id) AS event_id, coalesce(e.path, a.path) AS path,
  CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.type <> a.type THEN 'type' WHEN e.text IS DISTINCT FROM a.text THEN 'value' END AS field,
  coalesce(e.text, e.type) AS expected, coalesce(a.text, a.type) AS actual FROM e FULL JOIN a ON e.event_id = a.event_id AND e.path = a.path)
SELECT * FROM d WHERE field IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d t WHERE t.event_id = d.event_id AND t.field = d.field AND t.field IN ('missing', 'extra')
  AND (d.path LIKE t.path || '.%' OR d.path LIKE t.path || '[%'))""")
def state_fidelity(spark, sf_dir):
    """Where the state that a log shows and the one recorded beside it differ, member by member."""
    states = _states(spark, sf_dir)
    return trees.differences(*(trees.paths(states, ["event_id"], c) for c in ("state", "changed")), ["event_id"])


_LINES = "SELECT conv_id, turn, role, sha256(string_agg(role || ': ' || text, chr(10)) OVER w) AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"


def _digests(spark, sf_dir) -> DataFrame:
    return P.running_digests(turn_log(spark, sf_dir), "conv_id", ["turn"], F.concat("role", F.lit(": "), "text"))


@book.query(f"""WITH p AS ({_LINES}), q AS (SELECT *, lag(upto) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS last FROM p),
c AS (SELECT conv_id, turn, before, CASE WHEN conv_id % 5 = 0 AND last = 1 THEN upto WHEN conv_id % 7 = 3 AND turn < 3 THEN sha256('another text') ELSE before END AS claimed FROM q WHERE role = 'assistant')
SELECT c.conv_id, c.turn, CASE WHEN p.turn IS NULL THEN 'unknown' WHEN p.turn >= c.turn THEN 'future' ELSE 'past' END AS leak, p.turn AS at
FROM c LEFT JOIN p ON p.conv_id = c.conv_id AND p.upto = c.claimed WHERE c.claimed IS DISTINCT FROM c.before""")
def prompt_leak_lint(spark, sf_dir):
    """Prompts of the assistant's turns by digest, some of which hold their own answer or a text that is not the session's."""
    digests = _digests(spark, sf_dir)
    replies = digests.join(turn_log(spark, sf_dir).select("conv_id", "turn", "role"), ["conv_id", "turn"])
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    claimed = (
        F.when((F.col("conv_id") % 5 == 0) & F.col("_last"), F.col("upto"))
        .when((F.col("conv_id") % 7 == 3) & (F.col("turn") < 3), F.sha2(F.lit("another text"), 256)).otherwise(F.col("before"))
    )
    claims = replies.withColumn("_last", last).where("role = 'assistant'").select("conv_id", "turn", claimed.alias("claimed"))
    return P.prompt_leaks(claims, digests, "conv_id", "turn")


@book.query("""WITH p AS (SELECT conv_id, turn + 1 AS turn, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL), d AS (SELECT conv_id, turn, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(p.conv_id, d.conv_id) AS conv_id, coalesce(p.turn, d.turn) AS turn, CASE WHEN d.n IS NULL THEN 'prompt_without_decision' WHEN p.n IS NULL THEN 'decision_without_prompt' ELSE 'repeated' END AS problem
FROM p FULL JOIN d ON p.conv_id = d.conv_id AND p.turn = d.turn WHERE p.n IS NULL OR d.n IS NULL OR p.n > 1 OR d.n > 1""")
def prompt_decision_sets(spark, sf_dir):
    """Prompts, which every user turn makes for the next, and decisions, the assistant's turns, held to each other as sets of (stream, call)."""
    turns = turn_log(spark, sf_dir)
    prompts = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return J.set_differences(prompts, turns.where("role = 'assistant'").select("conv_id", "turn"), ["conv_id", "turn"], ("prompt_without_decision", "decision_without_prompt", "repeated"))
