"""Named queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import canonical, draws, edits, hashing, money, text, utf16
from millrace.plans.book import Book
from millrace.plans.log import turn_log
from millrace.session import table

book = Book()

_UNITS = "length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"
_ASTRAL = "CASE WHEN doc_id % 3 = 0 THEN chr(128512) || text ELSE text END"


def _astral(docs):
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\U0001f600"), "text")).otherwise(F.col("text")).alias("t"))


@book.query(f"""WITH d AS (SELECT doc_id, {_ASTRAL} AS t FROM documents)
SELECT doc_id, {_UNITS} AS units, CASE WHEN {_UNITS} >= 5 THEN CASE WHEN doc_id % 3 = 0 THEN t[1:4] ELSE t[1:5] END END AS first_five, t IS NOT NULL AND doc_id % 3 = 0 AS splits_at_one,
  CASE WHEN {_UNITS} >= 2 THEN CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) END AS point_of_two FROM d""")
def utf16_spans(spark, sf_dir):
    docs = _astral(table(spark, sf_dir, "documents"))
    t = F.col("t")
    return docs.select(
        "doc_id", utf16.units(t).alias("units"), utf16.piece(t, F.lit(0), F.lit(5)).alias("first_five"),
        utf16.splits_pair(t, F.lit(1)).alias("splits_at_one"), utf16.point_index(t, F.lit(2)).alias("point_of_two"),
    )


@book.query(f"SELECT doc_id, sha256({_ASTRAL}) AS joined_sha256, true AS same FROM documents")
def utf16_slice_roundtrip(spark, sf_dir):
    docs = _astral(table(spark, sf_dir, "documents"))
    half = F.floor(utf16.units(F.col("t")) / 2)
    cut = half + F.when(utf16.splits_pair(F.col("t"), half), 1).otherwise(0)
    both = F.concat(utf16.piece(F.col("t"), F.lit(0), cut), utf16.piece(F.col("t"), cut, utf16.units(F.col("t"))))
    return docs.select("doc_id", F.sha2(both, 256).alias("joined_sha256"), (both == F.col("t")).alias("same"))


@book.query("""SELECT p_partkey, 'sha256:' || sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS seal,
 sha256('part' || chr(0) || p_brand) AS key,
 sha256(encode('part') || unhex('00') || unhex(lpad(hex(strlen(p_brand)), 16, '0')) || encode(p_brand) || unhex(lpad(hex(strlen(p_size::VARCHAR)), 16, '0')) || encode(p_size::VARCHAR)) AS framed_sha256 FROM part""")
def canonical_digest_seal(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    framed = F.sha2(hashing.framed("part", [F.col("p_brand"), F.col("p_size").cast("string")]), 256)
    return parts.select("p_partkey", canonical.sealed(parts.columns).alias("seal"), hashing.joined_key([F.lit("part"), F.col("p_brand")]).alias("key"), framed.alias("framed_sha256"))


@book.query("""WITH h AS (SELECT c_custkey, sha256('7' || chr(0) || c_custkey) AS h FROM customer)
SELECT c_custkey, CAST(('0x' || h[1:16])::UBIGINT AS VARCHAR) AS draw, CAST(('0x' || h[1:16])::UBIGINT % 10 AS INTEGER) AS stream_class,
 list_reduce(list_prepend(0, list_transform(string_split(h, ''), lambda d: ('0x' || d)::INTEGER)), lambda a, d: (a * 16 + d) % 100) AS mod_100 FROM h""")
def named_stream_draws(spark, sf_dir):
    seed, stream = F.lit("7"), F.col("c_custkey").cast("string")
    draw = hashing.draw_u64(seed, stream)
    rest = hashing.modulo(hashing.joined_key([seed, stream]), 100)
    return table(spark, sf_dir, "customer").select("c_custkey", draw.cast("string").alias("draw"), (draw % 10).cast("int").alias("stream_class"), rest.alias("mod_100"))


def _u64(stream: str) -> str:
    return f"('0x' || sha256(c_custkey || chr(0) || {stream})[1:16])::UBIGINT"


@book.query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'stress' WHEN {_u64("'stream-class'")} % 10 = 0 THEN 'robustness' ELSE 'core' END AS stream_class, unnest([0, 1, 2]) AS call FROM customer),
d AS (SELECT *, {_u64("'service-time:' || call")} AS draw FROM c)
SELECT c_custkey, stream_class, call, CAST(CASE stream_class WHEN 'core' THEN [{', '.join(map(str, draws.SERVICE_MS))}][CAST(draw % 100 AS INTEGER) + 1] WHEN 'robustness' THEN 1500 + draw % 1501 ELSE 2000 + draw % 3001 END AS INTEGER) AS service_ms FROM d""")
def latency_inverse_cdf(spark, sf_dir):
    """The latency class of each customer as a stream, and the service times of its first three calls."""
    seed = F.col("c_custkey").cast("string")
    kind = draws.stream_class(F.col("c_mktsegment") == "BUILDING", hashing.draw_u64(seed, F.lit("stream-class")))
    calls = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("stream_class"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("call"))
    draw = hashing.draw_u64(seed, F.concat(F.lit("service-time:"), F.col("call").cast("string")))
    return calls.select("c_custkey", "stream_class", "call", draws.service_ms(F.col("stream_class"), draw).alias("service_ms"))


@book.query("""WITH h AS (SELECT c_custkey, CAST(('0x' || sha256('turn' || chr(0) || c_custkey)[1:8])::UBIGINT % 5 AS INTEGER) AS s FROM customer)
SELECT c_custkey, list_concat(['a','b','c','d','e'][s + 1:], ['a','b','c','d','e'][:s]) AS choices FROM h""")
def rotated_choices(spark, sf_dir):
    key = hashing.joined_key([F.lit("turn"), F.col("c_custkey").cast("string")])
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.rotated(F.array(*map(F.lit, "abcde")), key).alias("choices"))


@book.query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM benchmark)
SELECT item_id, len(ws) AS n_words, len(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) AS n_grams FROM w""")
def token_ngram_counts(spark, sf_dir):
    words = text.words(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("ws"))
    return items.select("item_id", F.size("ws").cast("long").alias("n_words"), F.size(F.array_distinct(text.token_ngrams(F.col("ws"), 4))).cast("long").alias("n_grams"))


_GRAMS = "list_distinct(CASE WHEN length({0}) >= 5 THEN list_transform(range(1, length({0}) - 3), lambda i: {0}[i:i + 4]) ELSE [{0}] END)"


@book.query(f"""WITH p AS (SELECT conv_id, turn, {_GRAMS.format('text')} AS g, lag({_GRAMS.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS pg FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(g, pg)) / len(list_distinct(list_concat(g, pg))), 6) AS jaccard FROM p WHERE pg IS NOT NULL""")
def adjacent_turn_jaccard(spark, sf_dir):
    from pyspark.sql import Window

    grams = turn_log(spark, sf_dir).withColumn("g", text.gram_hashes(5)("text"))
    pairs = grams.withColumn("pg", F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn"))).where("pg IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(text.jaccard(F.col("g"), F.col("pg")), 6).alias("jaccard"))


@book.query("""WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents)
SELECT doc_id, list_filter(range(0, len(cs) - 1), lambda i: cs[i + 1] = 'e' AND cs[i + 2] = 'n') AS places FROM c""")
def substring_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences("en")("text").alias("places"))


_PHRASES = (
    "Please highlight the second line", "Remind  me every day", "stop timer", "Cancel the timer now", "do not go", "don't go", "nothing to note", "look\tup this",
    "Set up another egg timer", "add an additional slow-cooker kitchen reminder", "Set another alarm", "try at 5", "once more", "three times", "untilted",
    "the final  evaluation", "a held-out part", "test set", "retest settled", "scoreboard", "Score it", "plain words alone", "set a timer", "schedule additional one two three four five timer",
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PHRASE_LIST = "[" + ", ".join(map(_quoted, _PHRASES)) + "]"
_FLAGS = {
    "directive": text.DIRECTIVE, "negation": text.NEGATION, "unsupported_timer": text.UNSUPPORTED_TIMER, "meta": text.META, "additional": text.ADDITIONAL,
}


@book.query(f"WITH p AS (SELECT o_orderkey, {_PHRASE_LIST}[o_orderkey % {len(_PHRASES)} + 1] AS phrase FROM orders) SELECT o_orderkey, phrase, "
            + ", ".join(f"regexp_matches(phrase, {_quoted(p)}) AS {name}" for name, p in _FLAGS.items()) + f", regexp_extract(phrase, {_quoted(text.META)}) AS meta_phrase FROM p")
def instruction_flags(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("o_orderkey") % len(_PHRASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", phrase.alias("phrase"))
    return rows.select("*", *(text.matches(F.col("phrase"), p).alias(name) for name, p in _FLAGS.items()), F.regexp_extract("phrase", text.ascii_pattern(text.META), 0).alias("meta_phrase"))


@book.query(f"""SELECT doc_id, regexp_matches(text, {_quoted(text.DIRECTIVE)}) AS directive, regexp_matches(text, {_quoted(text.NEGATION)}) AS negation,
 (length(text) - length(replace(text, '"', ''))) % 2 = 0 AND length(replace(text, '“', '')) = length(replace(text, '”', '')) AS balanced, len(regexp_extract_all(text, '[.!?]+')) AS n_sentences FROM documents""")
def phrase_rules(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.matches(t, text.DIRECTIVE).alias("directive"), text.matches(t, text.NEGATION).alias("negation"),
        text.balanced_quotes(t).alias("balanced"), F.regexp_count(t, F.lit(text.SENTENCE)).cast("long").alias("n_sentences"),
    )


@book.query("""WITH l AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM conversations)
SELECT conv_id, turn, array_to_string(ls[greatest(len(ls) - 1, 1):], chr(10)) AS tail FROM l""")
def last_two_lines(spark, sf_dir):
    return turn_log(spark, sf_dir).select("conv_id", "turn", F.array_join(text.last_lines(F.col("text"), 2), "\n").alias("tail"))


@book.query("""WITH o AS (SELECT o_orderkey, o_orderkey % 99 + 1 AS n, o_orderkey % 2 = 0 AS m FROM orders) SELECT o_orderkey, CAST(n * CASE WHEN m THEN 60000 ELSE 1000 END AS BIGINT) AS interval_ms, 'check order ' || o_orderkey AS message, o_orderkey % 5 = 0 AS another FROM o""")
def timer_grammar_roundtrip(spark, sf_dir):
    n, minutes = F.col("o_orderkey") % 99 + 1, F.col("o_orderkey") % 2 == 0
    message = F.concat(F.lit("check order "), F.col("o_orderkey").cast("string"))
    interval = (n * F.when(minutes, 60_000).otherwise(1000)).cast("long")
    instruction = text.render_timer(interval, message, F.col("o_orderkey") % 5 == 0)
    written = table(spark, sf_dir, "orders").select("o_orderkey", instruction.alias("instruction"))
    return text.parse_timer(written, "instruction").drop("instruction")


_PREFIX = "coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])), 0)"


@book.query(f"""WITH p AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a, text AS b FROM conversations),
x AS (SELECT *, {_PREFIX} AS pre FROM p), y AS (SELECT conv_id, turn, a = b AS same, reverse(a[pre + 1:]) AS a, reverse(b[pre + 1:]) AS b FROM x), z AS (SELECT *, {_PREFIX} AS suf FROM y)
SELECT conv_id, turn, CASE WHEN same THEN 'none' WHEN length(a) = suf THEN 'insert' WHEN length(b) = suf THEN 'delete' ELSE 'replace' END AS diff,
 CASE WHEN same THEN 'cursor_move' WHEN length(a) = suf AND turn % 2 = 0 THEN 'paste' WHEN length(a) = suf THEN 'insert' WHEN length(b) = suf THEN 'delete' ELSE 'replace' END AS edit FROM z""")
def turn_edit_kind(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turn_log(spark, sf_dir).select("conv_id", "turn", before.alias("a"), F.col("text").alias("b"))
    diffed = pairs.withColumn("diff", edits.diff_kind("a", "b"))
    hint = F.when(F.col("turn") % 2 == 0, "insertFromPaste").otherwise("insertText")
    return diffed.select("conv_id", "turn", "diff", edits.edit_kind(F.col("diff"), F.lit(True), hint).alias("edit"))


@book.query()
def revision_similarity(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turn_log(spark, sf_dir).select("conv_id", "turn", before.alias("a"), "text").where("a IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(edits.matching_ratio("a", "text"), 6).alias("ratio"))


@book.query("SELECT event_id, '{\"k\":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}' AS canonical, [json_extract_string(props, '$.k')] AS scalars FROM events")
def canonical_event_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", canonical.canonical_json("props").alias("canonical"), canonical.scalars("props").alias("scalars"))


@book.query("""SELECT source, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS n_tokens, CAST(round_even(CAST(sum((strlen(text) + 3) // 4) AS DECIMAL(18,0)) * 2.5::DECIMAL(4,2) / 1000000, 6) AS DOUBLE) AS cost,
 sum((strlen(text) + 3) // 4) * 1000 >= 12000 * 720 AS rolls_over, CAST(floor(sum(length(text)) / 7.0 + 0.5) AS BIGINT) AS rounded FROM documents GROUP BY source""")
def token_cost_forecast(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(money.tokens(F.col("text"))).alias("n_tokens"), F.sum(F.char_length("text")).alias("chars"))
    return sums.select(
        "source", "n_tokens", money.cost(F.col("n_tokens"), "2.5").cast("double").alias("cost"),
        money.over_budget(F.col("n_tokens"), 12_000, 720).alias("rolls_over"), money.half_up(F.col("chars") / 7).alias("rounded"),
    )


@book.query("""SELECT event_id, base64(encode(props)) AS encoded, props AS decoded, CAST(floor((0 - epoch_us(ts) % 1000003) / 1000) AS BIGINT) AS age_ms FROM events""")
def base64_roundtrip(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_003
    encoded = F.base64(F.encode("props", "UTF-8"))
    return table(spark, sf_dir, "events").select("event_id", encoded.alias("encoded"), F.decode(F.unbase64(encoded), "UTF-8").alias("decoded"), money.age_ms(F.lit(0), at * 1000).alias("age_ms"))


@book.query()
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized("text"), 256).alias("normalized_sha256"))
