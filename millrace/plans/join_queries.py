"""Named queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators.prefixes import running_digests
from millrace.plans.book import Book
from millrace.plans.log import LOG_SQL, event_log, turn_log
from millrace.session import table

book = Book()


def _kind(log, kind):
    return log.where(F.col("kind") == kind)


@book.query(f"""WITH {LOG_SQL}
SELECT p.session_id, p.seq, v.seq AS as_of_seq, v.k AS as_of_k FROM (SELECT * FROM log WHERE kind = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM log WHERE kind = 'view') v ON p.session_id = v.session_id AND p.seq >= v.seq""")
def decision_asof_latest_view(spark, sf_dir):
    log = event_log(spark, sf_dir)
    decisions = _kind(log, "purchase").select("session_id", "seq")
    return J.as_of(decisions, _kind(log, "view"), "session_id", "seq", "seq", ["seq", "k"])


@book.query(f"""WITH {LOG_SQL}, c AS (SELECT *, count(*) FILTER (WHERE kind = 'click') OVER (PARTITION BY session_id ORDER BY seq) AS n FROM log),
a AS (SELECT * FROM c WHERE kind = 'purchase')
SELECT session_id, seq, n - lag(n, 1, 0) OVER (PARTITION BY session_id ORDER BY seq) AS n_between FROM a""")
def events_between_purchases(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return J.count_between(_kind(log, "purchase"), _kind(log, "click"), "session_id", "seq")


@book.query(f"""WITH {LOG_SQL}, spans AS (SELECT session_id, seq // 20 AS segment_index, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY ALL)
SELECT l.session_id, l.seq, s.segment_index AS as_of_segment_index FROM log l JOIN spans s ON l.session_id = s.session_id AND l.seq BETWEEN s.first_seq AND s.last_seq WHERE l.kind = 'purchase'""")
def decision_segment_containment(spark, sf_dir):
    log = event_log(spark, sf_dir)
    spans = log.groupBy("session_id", F.floor(F.col("seq") / 20).alias("segment_index")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    points = _kind(log, "purchase").select("session_id", "seq")
    return J.containing(points, spans, "session_id", "seq", "first_seq", "last_seq", ["segment_index"])


@book.query("""SELECT conv_id, turn, sha256(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS prefix_sha256 FROM conversations""")
def turn_prefix_context(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text")
    return running_digests(turn_log(spark, sf_dir), "conv_id", ["turn"], line).select("conv_id", "turn", F.col("upto").alias("prefix_sha256"))


@book.query(f"""WITH {LOG_SQL}, d AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM log),
e AS (SELECT session_id, nth, min(seq) AS first, count(*) FILTER (WHERE kind = 'error') AS n FROM d WHERE nth > 0 GROUP BY ALL)
SELECT session_id, first, lead(first) OVER (PARTITION BY session_id ORDER BY nth) AS next_first, n FROM e""")
def decision_intervals(spark, sf_dir):
    return J.intervals(event_log(spark, sf_dir), "session_id", "seq", F.col("kind") == "purchase", F.col("kind") == "error")


@book.query(f"""WITH {LOG_SQL}, l AS (SELECT session_id, k, count(*) AS n, min(value) AS v FROM log WHERE kind = 'signup' GROUP BY ALL),
r AS (SELECT session_id, k, count(*) AS n, min(value) AS v FROM log WHERE kind = 'purchase' GROUP BY ALL)
SELECT * FROM (SELECT coalesce(l.session_id, r.session_id) AS session_id, coalesce(l.k, r.k) AS k,
  CASE WHEN l.n IS NULL THEN 'missing_left' WHEN r.n IS NULL THEN 'missing_right' WHEN l.n > 1 OR r.n > 1 THEN 'repeated' WHEN l.v IS DISTINCT FROM r.v THEN 'different' END AS reason
  FROM l FULL JOIN r ON l.session_id = r.session_id AND l.k = r.k) WHERE reason IS NOT NULL""")
def signup_bijection_check(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return J.bijection(_kind(log, "signup"), _kind(log, "purchase"), ["session_id", "k"], ["value"])


@book.query(f"""WITH {LOG_SQL}, a AS (SELECT session_id, seq AS frame_seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM log WHERE kind = 'view'),
b AS (SELECT session_id, seq AS ingress_seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM log WHERE kind = 'click')
SELECT session_id, place, frame_seq, ingress_seq FROM a FULL JOIN b USING (session_id, place)""")
def frame_ingress_zip(spark, sf_dir):
    log = event_log(spark, sf_dir)
    frames = _kind(log, "view").select("session_id", F.col("seq").alias("frame_seq"))
    ingress = _kind(log, "click").select("session_id", F.col("seq").alias("ingress_seq"))
    return J.zip_rows(frames, ingress, "session_id", ["frame_seq"], ["ingress_seq"])


@book.query(f"""WITH {LOG_SQL}, n AS (SELECT *, lead(kind) OVER w AS nk, lead(seq) OVER w AS second_seq FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq AS first_seq, second_seq, coalesce(nk = 'click', false) AS paired FROM n WHERE kind = 'view'""")
def started_finished_pairing(spark, sf_dir):
    return J.pair_up(event_log(spark, sf_dir), "session_id", "seq", "kind", "view", "click")


@book.query(f"""WITH {LOG_SQL}, p AS (SELECT *, lag(kind) OVER w AS bk, lag(seq) OVER w AS bs, lag(k % 5) OVER w AS b5 FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, CASE WHEN bk = 'click' AND b5 = k % 5 THEN bs END AS source FROM p WHERE kind = 'purchase'""")
def provenance_adjacent_join(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("k5", F.col("k") % 5)
    found = J.preceded_by(log, "session_id", "seq", F.col("kind") == "purchase", F.col("kind") == "click", ["k5"])
    return found.select("session_id", "seq", "source")


@book.query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def disposition_default_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return J.with_default(docs, labels, ["doc_id"], "quality", -1).withColumn("labelled", F.col("quality") >= 0)


@book.query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def label_coverage_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return J.unmatched(docs, table(spark, sf_dir, "labels"), {"doc_id": "doc_id"})


@book.query("""WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F'),
net AS (SELECT f, n, sum(s) AS net FROM (SELECT f, n, 1 AS s FROM a UNION ALL SELECT f, n, -1 FROM b) GROUP BY f, n)
SELECT f, n, CASE WHEN net > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(net) AS BIGINT) AS surplus FROM net WHERE net <> 0""")
def multiset_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return J.difference(lines.where("l_linestatus = 'O'").drop("l_linestatus"), lines.where("l_linestatus = 'F'").drop("l_linestatus"))


@book.query("""WITH m AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders),
g AS (SELECT o_custkey FROM m GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5) SELECT o_orderkey, o_custkey FROM m JOIN g USING (o_custkey)""")
def counterfactual_closure(spark, sf_dir):
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    declared = orders.withColumn("declared", F.array(*map(F.lit, priorities)))
    return J.complete_groups(declared, "o_custkey", "o_orderpriority", "declared").select("o_orderkey", "o_custkey")


@book.query(f"WITH {LOG_SQL} SELECT session_id, kind, seq, k FROM log QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY seq DESC) = 1")
def latest_by_key(spark, sf_dir):
    return J.latest(event_log(spark, sf_dir).select("session_id", "kind", "seq", "k"), ["session_id", "kind"], ["seq"])


@book.query("""WITH cur AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END AS brand, p_size + 1 AS size FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT coalesce(cur.id, new.id) AS id, cur.brand AS ob, cur.size AS os, new.brand AS nb, new.size AS ns, cur.id IS NOT NULL AND new.id IS NOT NULL AND cur.brand IS DISTINCT FROM new.brand AS collision FROM cur FULL JOIN new ON cur.id = new.id)
SELECT id, CASE WHEN nb IS NULL OR collision THEN ob ELSE nb END AS brand, CASE WHEN nb IS NULL OR collision THEN os ELSE ns END AS size, collision FROM b""")
def upsert_with_collisions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    new = parts.where("id % 2 = 0").select("id", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("brand")).alias("brand"), (F.col("size") + 1).alias("size"))
    return J.upsert(parts.where("id % 3 <> 0"), new, ["id"], ["brand"])


@book.query("""WITH t AS (SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT s_suppkey AS c_custkey, nullif(s_nationkey, 3) AS nk FROM supplier)
SELECT * FROM t UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.nk IS NOT DISTINCT FROM s.nk)""")
def history_backfill(spark, sf_dir):
    target = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey", "nullif(c_nationkey, 3) AS nk")
    source = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS c_custkey", "nullif(s_nationkey, 3) AS nk")
    return J.backfill(target, source, ["nk"])


@book.query("""SELECT o.o_orderkey, c.c_custkey, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_totalprice > 300000""")
def provenance_chain_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return found.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_custkey", "n_name", "r_name")


@book.query("""WITH t AS (SELECT a.conv_id, a.text AS question, b.text AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, count(*) AS n_pairs, count(*) FILTER (WHERE length(reply) > length(question)) AS n_longer FROM t GROUP BY conv_id""")
def twin_pairs(spark, sf_dir):
    turns = turn_log(spark, sf_dir)
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
    longer = F.char_length("reply") > F.char_length("question")
    return asked.join(told, ["conv_id", "turn"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(longer).alias("n_longer"))
