"""Named queries over planning and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import harness as H
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log
from millrace.session import table

book = Book()


@book.query("""WITH c AS (SELECT unnest(['g', 'p.v1.a', 'p.v1.b', 'p.v2.a', 'p.v2.b', 'p.v3.a', 'p.v3.b', 'l']) AS call) SELECT p_partkey AS probe, call, call || '.' || p_partkey AS call_id FROM part, c""")
def pairwise_plan(spark, sf_dir):
    return H.plan_calls(table(spark, sf_dir, "part"), "p_partkey", ("v1", "v2", "v3"), ("a", "b"))


@book.query("""WITH e AS (SELECT c_custkey AS id, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT o_custkey + 3 AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(e.id, f.id) AS id, CASE WHEN e.n IS NULL THEN 'unknown' WHEN f.n IS NULL THEN 'missing' WHEN e.n > 1 OR f.n > 1 THEN 'repeated' ELSE 'ok' END AS status FROM e FULL JOIN f ON e.id = f.id""")
def batch_artifact_reconcile(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    found = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 3).alias("id"))
    return H.reconcile(expected, found, "id")


@book.query(f"WITH {LOG_SQL} SELECT session_id FROM log GROUP BY session_id HAVING NOT min_by(value > 60, seq)")
def retry_set(spark, sf_dir):
    return H.to_retry(event_log(spark, sf_dir), "session_id", "seq", F.col("value") > 60)


@book.query("""WITH c AS (SELECT o_orderkey, o_orderstatus <> 'P' AS a, o_totalprice < 300000 AS b, o_orderpriority <> '5-LOW' AS c FROM orders)
SELECT o_orderkey, a AS schema_valid, a AND b AS license_allowed, a AND b AND c AS structural_match, CASE WHEN NOT a THEN 'schema_valid' WHEN NOT b THEN 'license_allowed' WHEN NOT c THEN 'structural_match' END AS failed_at FROM c""")
def generation_grading(spark, sf_dir):
    checks = {
        "schema_valid": F.col("o_orderstatus") != "P", "license_allowed": F.col("o_totalprice") < 300_000, "structural_match": F.col("o_orderpriority") != "5-LOW",
    }
    return H.grade(table(spark, sf_dir, "orders"), checks).select("o_orderkey", *checks, "failed_at")


_RANK = {"signup": 0, "view": 1, "click": 2, "purchase": 3}


@book.query(f"""WITH {LOG_SQL}, r AS (SELECT *, CASE kind WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS r FROM log WHERE kind <> 'error'),
b AS (SELECT *, max(r) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
SELECT session_id, arg_max(kind, (r, seq)) AS furthest, max(seq) AS last_event, bool_or(coalesce(r < m, false)) AS fell_back FROM b GROUP BY session_id""")
def batch_job_states(spark, sf_dir):
    return H.job_status(event_log(spark, sf_dir).where("kind <> 'error'"), "session_id", "seq", "kind", _RANK)


@book.query("""SELECT p_brand, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 45 DESC, p_partkey) AS place FROM part) WHERE place <= 5""")
def pilot_subset(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return H.anchored_subset(parts, ["p_brand"], F.col("p_size") > 45, "p_partkey", 5).select("p_brand", "p_partkey", "place")


@book.query(f"""WITH {LOG_SQL}, l AS (SELECT session_id, k, at_us - min(at_us) OVER (PARTITION BY session_id) AS at, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM log WHERE kind = 'view'),
r AS (SELECT session_id, k, at_us - min(at_us) OVER (PARTITION BY session_id) AS at, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM log WHERE kind = 'click'),
j AS (SELECT coalesce(l.session_id, r.session_id) AS session_id, coalesce(l.place, r.place) AS place, l.session_id IS NULL OR r.session_id IS NULL AS missing, abs(l.at - r.at) > 3600000000 AS t, l.k IS DISTINCT FROM r.k AS k FROM l FULL JOIN r ON l.session_id = r.session_id AND l.place = r.place)
SELECT session_id, CAST(place AS INTEGER) AS place, 'missing' AS field FROM j WHERE missing UNION ALL SELECT session_id, place::INTEGER, 'at' FROM j WHERE NOT missing AND t UNION ALL SELECT session_id, place::INTEGER, 'k' FROM j WHERE NOT missing AND k""")
def frame_sequence_comparison(spark, sf_dir):
    log = event_log(spark, sf_dir)
    left, right = (log.where(F.col("kind") == k) for k in ("view", "click"))
    return H.compare_sequences(left, right, "session_id", "seq", "at_us", 3_600_000_000, ["k"])


@book.query(f"""WITH {LOG_SQL}, p AS (SELECT session_id, min(seq) AS birth, max(seq) AS terminal FROM log WHERE kind = 'error' GROUP BY session_id)
SELECT l.session_id, l.seq, CASE WHEN l.seq >= terminal THEN 'ended' ELSE 'live' END AS status FROM log l JOIN p ON l.session_id = p.session_id WHERE l.seq >= birth""")
def need_expansion(spark, sf_dir):
    log = event_log(spark, sf_dir)
    plans = log.where("kind = 'error'").groupBy("session_id").agg(F.min("seq").alias("birth"), F.max("seq").alias("terminal"))
    return H.expand_needs(log.select("session_id", "seq"), plans, "session_id", "seq").select("session_id", "seq", "status")


@book.query("""WITH f AS (SELECT o_orderpriority AS family, o_custkey, count(*) AS u, sum(d) AS s, count(*) FILTER (WHERE d NOT BETWEEN 2 AND 6) AS o FROM (SELECT o_orderpriority, o_custkey, o_orderkey % 7 + 1 AS d FROM orders) GROUP BY ALL),
t AS (SELECT family, CAST(sum(s) AS BIGINT) AS realised, CAST(sum(o) AS BIGINT) AS out_of_band, count(*) FILTER (WHERE u > 1) AS reused_sources FROM f GROUP BY family)
SELECT family, realised, out_of_band, reused_sources, 12000::BIGINT AS target, realised = 12000 AND out_of_band = 0 AND reused_sources = 0 AS holds FROM t""")
def allocation_proof(spark, sf_dir):
    units = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), "o_custkey", (F.col("o_orderkey") % 7 + 1).alias("d"))
    target = units.select("family").distinct().withColumn("target", F.lit(12_000).cast("long"))
    return H.allocation(units, target, "family", "o_custkey", "d", 2, 6)


@book.query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.prompt_tokens') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS input_tokens, 0::BIGINT AS output_tokens FROM events""")
def usage_normalisation(spark, sf_dir):
    names = {"input_tokens": ("$.prompt_tokens", "$.k"), "output_tokens": ("$.completion_tokens", "$.output")}
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in H.usage(F.col("props"), names).items()))
