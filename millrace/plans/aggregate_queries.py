"""Named queries over aggregates, metrics, gates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import ranking as R
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log
from millrace.session import table

book = Book()
KINDS = ("click", "error", "purchase", "signup", "view")


@book.query("""SELECT CASE WHEN grouping(event_type) = 0 THEN event_type END AS kind, CASE WHEN grouping(user_id) = 0 THEN user_id END AS session_id,
  count(*) AS n, round(count(*) FILTER (WHERE value >= 100) / count(*), 6) AS pass_rate, CAST((1 - grouping(event_type)) + (1 - grouping(user_id)) AS INTEGER) AS level
FROM events GROUP BY GROUPING SETS ((), (event_type), (event_type, user_id))""")
def type_rate_by_user_grouping_sets(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("session_id"), "value")
    measures = [F.count(F.lit(1)).alias("n"), F.round(A.rate(F.col("value") >= 100), 6).alias("pass_rate")]
    return A.slices(log, [[], ["kind"], ["kind", "session_id"]], ["kind", "session_id"], measures)


@book.query("""WITH r AS (SELECT o_orderpriority, o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) / count(*) AS rate FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(max(rate) - min(rate), 6) AS spread FROM r GROUP BY o_orderpriority""")
def rate_spread(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    return A.spread(orders, ["o_orderpriority"], ["o_orderstatus"], F.col("o_totalprice") > 150000).select("o_orderpriority", F.round("spread", 6).alias("spread"))


@book.query("""SELECT round(abs(count(*) FILTER (WHERE l_linenumber % 2 = 0 AND l_returnflag = 'R') / count(*) FILTER (WHERE l_linenumber % 2 = 0)
 - count(*) FILTER (WHERE l_linenumber % 2 = 1 AND l_returnflag = 'R') / count(*) FILTER (WHERE l_linenumber % 2 = 1)), 6) AS position_bias FROM lineitem""")
def position_bias(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag")
    hit, even = F.col("l_returnflag") == "R", F.col("l_linenumber") % 2 == 0
    return lines.agg(F.round(F.abs(A.rate(hit, even) - A.rate(hit, ~even)), 6).alias("position_bias"))


@book.query("SELECT user_id AS session_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def action_count_vector(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type")
    return A.counts_vector(log, ["session_id"], "event_type", KINDS)


@book.query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS num, count(*) FILTER (WHERE l_quantity > 10) AS den, bool_or(l_discount >= 0.1) AS seen,
 round(sum(l_linenumber) / count(*) FILTER (WHERE l_quantity > 10), 6) AS value FROM lineitem GROUP BY ALL""")
def ratio_metric_merge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("num"), (F.col("l_quantity") > 10).cast("long").alias("den"), (F.col("l_discount") >= 0.1).alias("seen"))
    return A.ratio_metrics(parts, ["l_returnflag", "l_linestatus"]).withColumn("value", F.round("value", 6))


COMPARE_SQL = """WITH m AS (SELECT lang AS metric, quality, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id)),
s AS (SELECT metric, quality, count(v) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM m GROUP BY ALL),
j AS (SELECT r.metric, r.n, r.p10, r.p50, r.p90, s.n AS syn_n, s.p10 AS q10, s.p50 AS q50, s.p90 AS q90 FROM s r LEFT JOIN s ON r.metric = s.metric AND s.quality = 0 WHERE r.quality = 1),
c AS (SELECT metric, n, syn_n, CASE WHEN coalesce(syn_n, 0) = 0 THEN 'fail' WHEN abs(q10 - p10) <= abs(p10) * 0.2 + 1e-12 AND abs(q50 - p50) <= abs(p50) * 0.2 + 1e-12 AND abs(q90 - p90) <= abs(p90) * 0.2 + 1e-12 THEN 'pass' ELSE 'fail' END AS status FROM j)"""


def _compared(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("metric"), F.col("n_chars").cast("double").alias("v"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    reference, synthetic = (A.summary(rows.where(F.col("quality") == q), ["metric"], "v") for q in (1, 0))
    return A.compare_continuous(reference, synthetic, ["metric"], F.lit(False))


@book.query(COMPARE_SQL + " SELECT * FROM c")
def calibration_compare(spark, sf_dir):
    return _compared(spark, sf_dir).select("metric", "n", "syn_n", "status")


@book.query(COMPARE_SQL + " SELECT CASE WHEN metric IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS layer, CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM c GROUP BY layer")
def calibration_verdicts(spark, sf_dir):
    return A.verdicts(_compared(spark, sf_dir), F.when(F.col("metric").isin("en", "de"), "germanic").otherwise("romance"))


@book.query("""WITH r AS (SELECT l_shipmode, r, s FROM (SELECT l_linenumber AS l_shipmode, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS r,
 count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS s FROM lineitem GROUP BY l_linenumber))
SELECT l_shipmode AS metric, CASE WHEN r IS NULL THEN 'not_applicable' WHEN s IS NULL THEN 'fail' WHEN abs(s - r) <= 0.05 + 1e-12 THEN 'pass' ELSE 'fail' END AS categorical,
 CASE WHEN r IS NULL THEN 'not_applicable' WHEN s IS NULL THEN 'fail' WHEN (r = 0 AND s = 0) OR (r <> 0 AND abs(s - r) <= abs(r) * 0.15 + 1e-12) THEN 'pass' ELSE 'fail' END AS relative FROM r""")
def ratio_tolerances(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("metric"), "l_returnflag", "l_linestatus")
    done = F.col("l_linestatus") == "F"
    rates = lines.groupBy("metric").agg(*(A.rate(F.col("l_returnflag") == f, done).alias(n) for f, n in (("R", "r"), ("A", "s"))))
    return rates.select("metric", *(A.compare_ratio(F.col("r"), F.col("s"), F.lit(k)).alias(n) for k, n in ((True, "categorical"), (False, "relative"))))


@book.query("""WITH v AS (SELECT avg(quality) AS quality_rate, 1 - avg(toxic) AS clean_rate, count(*)::DOUBLE AS n_labels FROM labels)
SELECT 'quality_rate' AS gate, round(quality_rate, 6) AS value, quality_rate >= 0.8 AS passed FROM v UNION ALL SELECT 'clean_rate', round(clean_rate, 6), clean_rate >= 0.99 FROM v UNION ALL SELECT 'n_labels', n_labels, n_labels <= 100000000 FROM v""")
def label_gate_verdicts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    values = labels.agg(F.avg("quality").alias("quality_rate"), (1 - F.avg("toxic")).alias("clean_rate"), F.count(F.lit(1)).alias("n_labels"))
    return A.gates(values, {"quality_rate": (">=", 0.8), "clean_rate": (">=", 0.99), "n_labels": ("<=", 1e8)}).withColumn("value", F.round("value", 6))


_SPLITS = ("train", "dev", "test", "demo")


@book.query("""WITH d AS (SELECT ['train', 'dev', 'test', 'demo'][CAST(substr(source, 4) AS INTEGER) % 4 + 1] AS split, unnest([
  {label: 'stream', value: sha256(text)}, {label: 'template', value: sha256(lang || ':' || n_chars // 100)}, {label: 'timing seed material', value: sha256(source)},
  {label: 'lookup value', value: sha256(split_part(text, ' ', 1))}, {label: 'tool result', value: sha256(lower(substr(text, 1, 20)))},
  {label: 'timer message', value: sha256(split_part(text, chr(10), 1))}]) AS f FROM documents)
SELECT f.label AS label, f.value AS value, list_sort(list(DISTINCT split)) AS owners FROM d GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def split_ledger_reuse(spark, sf_dir):
    splits = F.array(*map(F.lit, _SPLITS))
    split = F.element_at(splits, (F.substring("source", 4, 9).cast("int") % 4 + 1).cast("int"))
    values = {
        "stream": F.col("text"), "template": F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 100).cast("string")), "timing seed material": F.col("source"),
        "lookup value": F.split_part("text", F.lit(" "), F.lit(1)), "tool result": F.lower(F.substring("text", 1, 20)),
        "timer message": F.split_part("text", F.lit("\n"), F.lit(1)),
    }
    families = F.array(*(F.struct(F.lit(label).alias("label"), F.sha2(value, 256).alias("value")) for label, value in values.items()))
    rows = table(spark, sf_dir, "documents").select(split.alias("split"), F.explode(families).alias("f")).select("split", "f.*")
    return A.crossing_owners(rows, ["label", "value"], "split")


@book.query("""WITH t AS (SELECT DISTINCT o_orderpriority, 3000::BIGINT AS target FROM orders), r AS (SELECT o_orderpriority, count(*) AS realised FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderpriority, coalesce(realised, 0) AS realised, target, target - coalesce(realised, 0) AS missing FROM t LEFT JOIN r USING (o_orderpriority)""")
def realised_against_target(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    target = orders.select("o_orderpriority").distinct().withColumn("target", F.lit(3000).cast("long"))
    return A.against_target(orders.where("o_orderstatus = 'F'"), target, "o_orderpriority", F.lit(1).cast("long"))


@book.query("""WITH u AS (SELECT o_custkey AS unit, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b, count(*) AS programs FROM orders GROUP BY 1)
SELECT [a, b] AS vector, count(*) AS n_units, min(unit) AS first_unit, CAST(sum(programs) AS BIGINT) AS programs FROM u GROUP BY a, b""")
def yield_shapes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), "o_orderstatus")
    units = orders.groupBy("unit").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"), F.count(F.lit(1)).alias("programs"))
    return A.yield_shapes(units, "unit", ["a", "b"], "programs")


@book.query("""WITH g AS (SELECT o_custkey, count(*) AS n, max(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 ELSE 1 END) AS rarity, list_sort(list(o_orderkey)) AS items FROM orders GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY rarity ORDER BY o_custkey) AS place_in_rarity FROM g""")
def stream_review_queue(spark, sf_dir):
    score = F.create_map(F.lit("1-URGENT"), F.lit(5), F.lit("2-HIGH"), F.lit(3))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.try_element_at(score, F.col("o_orderpriority")), F.lit(1)).alias("r"))
    return A.queue(orders, "o_custkey", "r", "o_orderkey")


@book.query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return A.repeated(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"])


@book.query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS distinct_types, min(c) AS min_candidates, max(c) AS max_candidates
FROM (SELECT o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS c FROM orders) GROUP BY o_custkey""")
def candidate_coverage(spark, sf_dir):
    by_status = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("c"))
    types = F.size(F.array_distinct(F.flatten(F.collect_list("p")))).cast("long")
    return by_status.groupBy("o_custkey").agg(types.alias("distinct_types"), F.min("c").alias("min_candidates"), F.max("c").alias("max_candidates"))


@book.query(f"WITH {LOG_SQL} SELECT session_id, kind, min_by(seq, (k, seq)) AS seq, min_by(k, (k, seq)) AS k FROM log GROUP BY ALL")
def open_items_top1(spark, sf_dir):
    return R.first_by(event_log(spark, sf_dir), ["session_id", "kind"], ["k", "seq"], ["seq", "k"])


@book.query("""WITH m AS (SELECT o_custkey, o_orderkey, o_orderpriority, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS l FROM orders)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(DISTINCT o_orderkey) > 1 AS ambiguous FROM m WHERE o_orderpriority = l GROUP BY o_custkey""")
def unique_minimum(spark, sf_dir):
    return R.unique_minimum(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


_RANK = "sha256('review-v1' || chr(0) || doc_id)"


@book.query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_RANK}) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= (n * 10 + 99) // 100""")
def stratified_ceil10_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.stratified_share(docs, "source", R.hash_rank(F.col("doc_id"), "review-v1"), 10)


@book.query(f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}) AS position FROM documents")
def hash_ranked_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.presented(docs, "lang", R.hash_rank(F.col("doc_id"), "review-v1"))


@book.query("""WITH t AS (SELECT DISTINCT lang, 100 * (doc_id % 40) AS wanted FROM documents), p AS (SELECT lang, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY ALL)
SELECT t.lang, wanted, arg_min(p.doc_id, (abs(n_chars - wanted), p.doc_id)) AS doc_id FROM t JOIN p USING (lang) GROUP BY ALL""")
def nearest_length_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    targets = docs.select("lang", (100 * (F.col("doc_id") % 40)).alias("wanted")).distinct()
    return R.nearest_length(targets, docs, "lang", "n_chars", "wanted", "doc_id")


@book.query("""SELECT source, count(*) AS n_streams, CAST(sum(n_chars) AS BIGINT) AS n_decisions, list_sort(list(DISTINCT lang)) AS regimes,
 count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en FROM documents GROUP BY source""")
def family_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_streams"), F.sum("n_chars").alias("n_decisions"), F.array_sort(F.collect_set("lang")).alias("regimes"),
        *(F.count_if(F.col("lang") == c).alias(c) for c in ("de", "en")),
    )
