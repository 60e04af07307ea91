"""Named queries over grading, follow-up plans, totals and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import sequence
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log
from millrace.session import table

book = Book()


@book.query("""WITH r AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ranking, min(o_orderkey) AS expected, max(o_orderkey) AS tempting FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(ranking) AS candidates, ranking[1] = expected AS top1_correct, list_position(ranking, expected) < list_position(ranking, tempting) AS expected_above_tempting FROM r WHERE len(ranking) > 1""")
def listwise_grading(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranking = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))), lambda x: x["k"])
    found = orders.groupBy("o_custkey").agg(ranking.alias("ranking"), F.min("o_orderkey").alias("expected"), F.max("o_orderkey").alias("tempting")).where(F.size("ranking") > 1)
    place = lambda c: F.array_position("ranking", F.col(c))
    return found.select("o_custkey", F.size("ranking").cast("long").alias("candidates"), (F.get("ranking", F.lit(0)) == F.col("expected")).alias("top1_correct"), (place("expected") < place("tempting")).alias("expected_above_tempting"))


@book.query("""WITH g AS (SELECT p_partkey, p_brand, p_size > 10 AS structural, p_type LIKE '%S%' AS open_text FROM part)
SELECT 's1.' || p_partkey AS call_id, p_brand AS family FROM g WHERE structural AND open_text UNION ALL SELECT 'p1.' || p_partkey, p_brand FROM g WHERE NOT structural""")
def follow_up_plan(spark, sf_dir):
    structural, open_text = F.col("p_size") > 10, F.col("p_type").contains("S")
    stage = F.when(structural & open_text, "s1").when(~structural, "p1")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", stage.alias("stage")).where("stage IS NOT NULL")
    return parts.select(F.concat_ws(".", "stage", F.col("p_partkey").cast("string")).alias("call_id"), F.col("p_brand").alias("family"))


_RESPONSE = """CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{"type":' WHEN 3 THEN '{"type":"hum"}' ELSE '{"type":"' || ['idle', 'respond', 'nudge'][k % 3 + 1] || '"}' END"""


@book.query(f"""WITH {LOG_SQL}, r AS (SELECT event_id, {_RESPONSE} AS body, k FROM log) SELECT event_id, CASE WHEN body IS NULL THEN 'no_response' WHEN body = '' THEN 'empty' WHEN event_id % 5 = 2 THEN 'malformed' WHEN event_id % 5 = 3 THEN 'unknown_action' ELSE 'action' END AS outcome,
CASE WHEN event_id % 5 = 4 THEN ['idle', 'respond', 'nudge'][k % 3 + 1] END AS action FROM r""")
def response_decode_ladder(spark, sf_dir):
    m, kinds = F.col("event_id") % 5, F.array(*map(F.lit, ("idle", "respond", "nudge")))
    name = F.element_at(kinds, (F.col("k") % 3 + 1).cast("int"))
    body = F.when(m == 1, "").when(m == 2, '{"type":').when(m == 3, '{"type":"hum"}').when(m == 4, F.concat(F.lit('{"type":"'), name, F.lit('"}')))
    rows = event_log(spark, sf_dir).select("event_id", body.alias("body"))
    read = rows.withColumn("type", F.try_variant_get(F.try_parse_json("body"), "$.type", "string")).withColumn("parses", F.try_parse_json("body").isNotNull())
    known = F.col("type").isin("idle", "respond", "nudge")
    outcome = F.when(F.col("body").isNull(), "no_response").when(F.col("body") == "", "empty").when(~F.col("parses"), "malformed").when(~F.coalesce(known, F.lit(False)), "unknown_action").otherwise("action")
    return read.select("event_id", outcome.alias("outcome"), F.when(known, F.col("type")).alias("action"))


@book.query("""SELECT source, count(*) AS labelled, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS passed_toxic, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS failed_clean, round(count(*) FILTER (WHERE (quality = 1) = (toxic = 0)) / count(*), 6) AS agreement
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def label_agreement_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("labelled"), F.count_if(good).alias("passed"), F.count_if(good & ~clean).alias("passed_toxic"), F.count_if(~good & clean).alias("failed_clean"),
        F.round(F.count_if(good == clean) / F.count(F.lit(1)), 6).alias("agreement"),
    )


@book.query(f"""WITH {LOG_SQL}, r AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY session_id ORDER BY seq) THEN 1 ELSE 0 END AS starts FROM log)
SELECT session_id, count(*) AS steps, count(DISTINCT kind) AS kinds, CAST(sum(starts) AS BIGINT) AS runs, CAST(sum(k) FILTER (WHERE kind = 'view') AS BIGINT) AS typed, count(*) FILTER (WHERE kind = 'error') AS pauses FROM r GROUP BY session_id""")
def script_summary(spark, sf_dir):
    log = event_log(spark, sf_dir)
    before = F.lag("kind").over(sequence.ordered("session_id", ["seq"]))
    starts = F.when(F.col("kind").eqNullSafe(before), 0).otherwise(1)
    return log.withColumn("starts", starts).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count_distinct("kind").alias("kinds"), F.sum("starts").cast("long").alias("runs"),
        F.sum(F.when(F.col("kind") == "view", F.col("k"))).alias("typed"), F.count_if(F.col("kind") == "error").alias("pauses"),
    )


_POOL = (80, 95, 110, 120, 150, 210, 260, 330, 480, 900)
_U32 = "('0x' || sha256('pool' || chr(0) || {})[1:8])::UBIGINT"


@book.query(f"""WITH d AS (SELECT c_custkey, [{', '.join(map(str, _POOL))}][CAST(floor({_U32.format('c_custkey')} / 4294967296.0::DOUBLE * 10) AS INTEGER) + 1] AS base, {_U32.format("c_custkey || ':j'")} / 4294967296.0::DOUBLE AS r FROM customer)
SELECT c_custkey, base, CAST(greatest(90, least(500, base + floor((r - 0.5) * 60))) AS BIGINT) AS jittered FROM d""")
def bootstrap_draws(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    unit = lambda k: F.conv(F.substring(hashing.joined_key([F.lit("pool"), k]), 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*map(F.lit, _POOL)), F.floor(unit(key) * 10).cast("int")).alias("base"), unit(F.concat(key, F.lit(":j"))).alias("r"))
    moved = F.col("base") + F.floor((F.col("r") - 0.5) * 60)
    return drawn.select("c_custkey", "base", F.greatest(F.lit(90), F.least(F.lit(500), moved)).cast("long").alias("jittered"))


@book.query("""WITH t AS (SELECT o_orderkey, 'Order ' || o_orderkey || ' costs ' || CAST(floor(o_totalprice) AS BIGINT) || ' of 7' AS asked, 'It is ' || o_orderkey || ', about ' || CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 2 || ', in ' || o_orderkey % 9 AS told FROM orders),
n AS (SELECT o_orderkey, list_distinct(regexp_extract_all(told, '[0-9]+')) AS told, regexp_extract_all(asked, '[0-9]+') AS asked FROM t)
SELECT o_orderkey, list_sort(list_filter(told, lambda x: NOT list_contains(asked, x))) AS ungrounded FROM n""")
def number_grounding(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text("Order ", key, " costs ", price, " of 7").alias("asked"), text("It is ", key, ", about ", price + key % 2, ", in ", key % 9).alias("told"))
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return rows.select("o_orderkey", F.array_sort(F.array_except(numbers("told"), numbers("asked"))).alias("ungrounded"))


@book.query("""WITH c AS (SELECT o_orderpriority AS family, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS before, count(*) AS after FROM orders GROUP BY 1) SELECT family, before, after, after - before AS delta FROM c""")
def inventory_delta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    before = F.count_if(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    counted = orders.groupBy(F.col("o_orderpriority").alias("family")).agg(before.alias("before"), F.count(F.lit(1)).alias("after"))
    return counted.withColumn("delta", F.col("after") - F.col("before"))
