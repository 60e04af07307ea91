"""Named queries that choose: covers of strata, totals that programs reach, and draws held to a total."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import draws
from millrace.operators import covers as C
from millrace.operators import synthesis
from millrace.operators.ranking import hash_rank
from millrace.plans.book import Book
from millrace.session import table

book = Book()


@book.query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(['lang:' || coalesce(lang, ''), 'source:' || coalesce(source, ''), 'length:' || length(text) // 500, 'pair:' || coalesce(lang, '') || (doc_id % 7)]) AS label FROM documents),
k AS (SELECT doc_id, sha256('review' || chr(0) || doc_id) AS rank FROM documents), n AS (SELECT count(DISTINCT label) AS n FROM l),
r AS (SELECT 0 AS step, []::VARCHAR[] AS covered, []::BIGINT[] AS taken
  UNION ALL SELECT step + 1, (SELECT list(DISTINCT label) FROM l WHERE list_contains(picked, doc_id)), picked FROM (
    SELECT r.step, list_append(r.taken, (SELECT doc_id FROM l JOIN k USING (doc_id) WHERE NOT list_contains(r.covered, label) GROUP BY doc_id, rank ORDER BY count(*) DESC, rank LIMIT 1)) AS picked
    FROM r, n WHERE len(r.covered) < n.n)),
c AS (SELECT unnest(taken) AS doc_id FROM (SELECT taken FROM r ORDER BY step DESC LIMIT 1)), s AS (SELECT count(*) AS n FROM documents),
f AS (SELECT doc_id, row_number() OVER (ORDER BY rank) AS place FROM k WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, true AS in_cover FROM c UNION ALL SELECT doc_id, false FROM f, s WHERE place <= greatest(least(greatest(floor(s.n * 0.15 + 0.5), ceil(s.n * 0.1)), floor(s.n * 0.6)), (SELECT count(*) FROM c)) - (SELECT count(*) FROM c)""")
def review_cover(spark, sf_dir):
    """A review sample of documents that covers every stratum of language, source, length and part, then goes on in hash order."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = table(spark, sf_dir, "documents")
    strata = F.array(
        F.concat(F.lit("lang:"), text("lang")), F.concat(F.lit("source:"), text("source")),
        F.concat(F.lit("length:"), F.floor(F.char_length("text") / 500).cast("string")), F.concat(F.lit("pair:"), text("lang"), (F.col("doc_id") % 7).cast("string")),
    )
    return C.cover_and_fill(docs.select("doc_id", F.explode(strata).alias("label")), "doc_id", "label", hash_rank(F.col("doc_id"), "review"), 0.1, 0.15, 0.6)


_COUNTS = ("marks", "replies", "timers")
_TARGET = (31, 24, 13)


@book.query(f"""WITH RECURSIVE p AS (SELECT c_mktsegment, c_nationkey, 3 + count(*) % 4 AS marks, 3 * (sum(c_custkey) % 3)::BIGINT AS replies, 2 * (count(*) % 2) AS timers FROM customer GROUP BY ALL),
s AS (SELECT DISTINCT c_mktsegment, 0::BIGINT AS marks, 0::BIGINT AS replies, 0::BIGINT AS timers FROM customer
  UNION SELECT s.c_mktsegment, s.marks + p.marks, s.replies + p.replies, s.timers + p.timers FROM s JOIN p USING (c_mktsegment) WHERE s.marks + p.marks <= {_TARGET[0]} AND s.replies + p.replies <= {_TARGET[1]} AND s.timers + p.timers <= {_TARGET[2]}),
g AS (SELECT c_mktsegment, {_TARGET[0]} - marks AS a, {_TARGET[1]} - replies AS b, {_TARGET[2]} - timers AS c FROM s),
m AS (SELECT c_mktsegment, count(*) AS n_totals, min({{'t': a + b + c, 'a': a, 'b': b, 'c': c}}) AS best FROM g GROUP BY c_mktsegment)
SELECT c_mktsegment, best.t = 0 AS reachable, n_totals, best.a AS gap_marks, best.b AS gap_replies, best.c AS gap_timers FROM m""")
def exact_reach(spark, sf_dir):
    """Whether a segment's programs, one for each nation, add up to its target of actions, and what the closest total lacks."""
    n, ids = F.count(F.lit(1)), F.sum("c_custkey")
    programs = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        (3 + n % 4).alias("marks"), (3 * (ids % 3)).alias("replies"), (2 * (n % 2)).alias("timers")
    )
    targets = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().select("c_mktsegment", *(F.lit(t).cast("long").alias(c) for t, c in zip(_TARGET, _COUNTS, strict=True)))
    reached = C.exact_reach(programs, targets, "c_mktsegment", "c_nationkey", _COUNTS)
    return C.closest(reached, targets, "c_mktsegment", _COUNTS).drop("uses")


def _times32(a: str, b: str) -> str:
    return f"CAST(({a})::HUGEINT * ({b}) % 4294967296 AS BIGINT)"


def _seed_sql(text: str) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT), lambda h, u: {_times32('xor(h, u)', str(draws.FNV_PRIME))}, {draws.FNV_OFFSET}::BIGINT)"


def _draw_sql(columns: str, seed: str, nth: str, source: str) -> str:
    """A query of ``columns`` and the draw ``d``."""
    state = f"SELECT {columns}, ({seed} + {_times32(nth, str(draws.STEP))}) % 4294967296 AS s FROM {source}"
    mixed = f"SELECT *, {_times32('xor(s, s >> 15)', 's | 1')} AS m FROM ({state})"
    more = f"SELECT *, xor(m, (m + {_times32('xor(m, m >> 7)', 'm | 61')}) % 4294967296) AS x FROM ({mixed})"
    return f"SELECT {columns}, xor(x, x >> 14) AS d FROM ({more})"


_RADICES = (7, 24, 60, 1000)


def _radix_sql() -> str:
    steps, digits = [], "list_transform(regexp_extract_all(sha256('pick:' || event_id), '....'), lambda h: {'q': [('0x' || h)::BIGINT], 'r': 0::BIGINT})"
    for i, r in enumerate(_RADICES):
        worked = f"list_reduce({digits}, lambda a, x: {{'q': list_append(a.q, (a.r * 65536 + x.q[1]) // {r}), 'r': (a.r * 65536 + x.q[1]) % {r}}}, {{'q': []::BIGINT[], 'r': 0::BIGINT}})"
        steps.append(f"r{i} AS (SELECT *, {worked} AS w{i} FROM {f'r{i - 1}' if i else 'events'})")
        digits = f"list_transform(w{i}.q, lambda v: {{'q': [v], 'r': 0::BIGINT}})"
    return ", ".join(steps)


@book.query(f"""WITH {_radix_sql()} SELECT event_id, d AS first_draw, {', '.join(f'w{i}.r AS digit_{i}' for i in range(len(_RADICES)))}
FROM r{len(_RADICES) - 1} JOIN ({_draw_sql('event_id', _seed_sql("'string:' || user_id || ':events'"), "event_id", 'events')}) seeded USING (event_id)""")
def seeded_draws(spark, sf_dir):
    """A user's stream of draws by the number of the event, and four choices out of one digest for each event."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    digits = draws.mixed_radix(F.sha2(F.concat(F.lit("pick:"), F.col("event_id").cast("string")), 256), _RADICES)
    drawn = draws.draw32(draws.seed_of(F.col("user_id"), "events"), F.col("event_id"))
    return rows.select("event_id", drawn.alias("first_draw"), digits.alias("d")).select("event_id", "first_draw", *(F.col("d")[i].alias(f"digit_{i}") for i in range(len(_RADICES))))


@book.query(f"""WITH b AS (SELECT user_id, count(*) AS n, CAST(sum(k) AS BIGINT) + count(*) AS total FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click') GROUP BY user_id),
a AS (SELECT list(k ORDER BY k) AS pool FROM (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view')),
r AS (SELECT user_id, total, {_seed_sql("'string:' || user_id || ':intervals'")} AS seed, unnest(range(1, n + 1)) AS nth FROM b),
d1 AS ({_draw_sql('user_id, total, nth', 'seed', '3 * (nth - 1) + 1', 'r')}), d2 AS (SELECT user_id AS u, nth AS i, d FROM ({_draw_sql('user_id, nth', 'seed', '3 * (nth - 1) + 2', 'r')})), d3 AS (SELECT user_id AS u, nth AS i, d FROM ({_draw_sql('user_id, nth', 'seed', '3 * (nth - 1) + 3', 'r')})),
v AS (SELECT d1.user_id, d1.total, d1.nth, d3.d AS o, greatest(1, least(99, pool[CAST(floor(d1.d / 4294967296.0::DOUBLE * len(pool)) AS BIGINT) + 1] + CAST(floor(d2.d / 4294967296.0::DOUBLE * 9) AS BIGINT) - 4)) AS drawn
  FROM d1 JOIN d2 ON d2.u = d1.user_id AND d2.i = d1.nth JOIN d3 ON d3.u = d1.user_id AND d3.i = d1.nth, a),
l AS (SELECT *, total - sum(drawn) OVER (PARTITION BY user_id) AS lack FROM v), m AS (SELECT *, CASE WHEN lack > 0 THEN 99 - drawn ELSE drawn - 1 END AS room FROM l),
x AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY user_id ORDER BY o, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(room) OVER (PARTITION BY user_id) AS rooms FROM m)
SELECT user_id, nth, CAST(drawn AS BIGINT) AS drawn, CASE WHEN rooms >= abs(lack) THEN CAST(drawn + sign(lack) * greatest(0, least(room, abs(lack) - before)) AS BIGINT) END AS interval FROM x""")
def bootstrap_intervals(spark, sf_dir):
    """Intervals of each user's clicks, drawn from those of all views and held to the user's own total."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", k.alias("k"))
    bursts = events.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("k") + F.count(F.lit(1))).alias("total"))
    atoms = events.where("event_type = 'view'").select("k").distinct()
    return synthesis.intervals_to_total(bursts, "user_id", F.col("user_id"), "n", "total", atoms, "k", 100, 4)
