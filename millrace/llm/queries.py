"""The queries of this subpackage with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat,
    compression_bands,
    conversation_repair,
    decontamination,
    importance,
    language_id,
    line_dedup,
    mixing,
    quality_trees,
    secret_scan,
    simhash,
    token_attribution,
    warc,
)
from millrace.llm.text import held_out
from millrace.session import cut_lineage, table

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


#: The pages table has no capture time; its records carry this one.
CAPTURED = "2024-01-01T00:00:00Z"


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.derive(warc.responses(pages, CAPTURED)).withColumnRenamed("key", "page_id")


def _op1_sql() -> str:
    """SQL of the derivatives, with patterns of its own: it shares none with the operator."""
    silent = "|".join(f"{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|$)" for tag in "title template noscript style script".split())
    COMMENT, SILENT = "(?s)<!--.*?(?:-->|$)", f"(?is)<(?:{silent})"
    blocks = """p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hr tr td th table thead tbody tfoot caption form fieldset pre address
        article aside section header footer nav main figure figcaption blockquote body html""".split()
    BLOCK, INLINE = f"(?i)<(?:/|)(?:{'|'.join(blocks)})\\b[^>]*>", "(?s)<[A-Za-z/!?][^>]*(?:>|$)"
    SPACE, ENDS = "[ \\t\\v\\f\\r\u00a0]+", " ?\\n[ \\n]*"
    TITLE = "(?is)<title\\b[^>]*>(.*?)</title\\s*>"
    LINK = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"'>]*)[\"']"

    def quoted(text: str) -> str:
        plain = text.replace("'", "''")
        return "'" + plain.replace("\r", "'||chr(13)||'").replace("\n", "'||chr(10)||'") + "'"

    def replaced(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"

    def decoded(text: str) -> str:
        names = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in html5.items())
        older = "|".join(sorted({k for k in html5 if k[-1] != ";"}, key=len, reverse=True))
        number, name = "regexp_extract(p, '^#([0-9]+|[xX][0-9A-Fa-f]+)')", "regexp_extract(p, '^[a-zA-Z][a-zA-Z0-9]*;?')"
        prefix = f"regexp_extract({name}, '^({older})')"
        digits = f"CASE WHEN lower({number}[2]) = 'x' THEN '0x' || ltrim({number}[3:], '0') ELSE ltrim({number}[2:], '0') END"
        code = f"CASE WHEN length({digits}) > 10 THEN 0 ELSE coalesce(TRY_CAST({digits} AS BIGINT), 0) END"
        western = ", ".join(f"{i}: {ord(c)}" for i in range(128, 160) if (c := bytes([i]).decode("cp1252", "ignore")))
        moved = f"coalesce((MAP {{{western}}})[CAST({code} AS INTEGER)], {code})"
        char = f"chr(CAST(CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {moved} ELSE 65533 END AS INTEGER))"
        piece = f"""CASE WHEN {number} <> '' THEN {char} || regexp_replace(p[length({number}) + 1:], '^;', '')
            WHEN (MAP {{{names}}})[{name}] IS NOT NULL THEN (MAP {{{names}}})[{name}] || p[length({name}) + 1:]
            WHEN {prefix} <> '' THEN (MAP {{{names}}})[{prefix}] || p[length({prefix}) + 1:] ELSE '&' || p END"""
        parts = f"string_split({text}, '&')"
        return f"{parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {piece}), '')"

    def urn(text: str) -> str:
        return f"'<urn:uuid:' || regexp_replace(sha256({text}), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}}).*$', '\\1-\\2-5\\3-8\\4-\\5') || '>'"

    def digest(text: str) -> str:
        return f"'sha256:' || sha256({text})"

    crlf = "chr(13) || chr(10)"
    untagged = replaced(replaced(replaced(replaced("body", COMMENT, ""), SILENT, ""), BLOCK, "\n"), INLINE, "")
    squeezed = "trim(" + replaced(replaced("decoded", SPACE, " "), ENDS, "\n") + ", ' ' || chr(10))"
    title = "trim(" + replaced(decoded(f"regexp_extract(body, {quoted(TITLE)}, 1)"), "[ \t\r\n\f]+", " ") + ")"
    link = replaced("replace(l, '&amp;', '&')", "[\r\n]+", "")
    return f"""
WITH response AS (
  SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS uri, coalesce(html, '') AS body,
         {urn("'response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '')")} AS record_id,
         'Content-Type: text/html; charset=utf-8' AS h2, 'Content-Length: ' || strlen(coalesce(html, '')) AS h3
  FROM pages
), untagged AS (SELECT *, {untagged} AS untagged FROM response
), decoded AS (SELECT *, {decoded("untagged")} AS decoded FROM untagged
), parts AS (
  SELECT page_id, uri, record_id, {squeezed} AS text, {title} AS title, h2, h3,
         array_to_string(list_transform(regexp_extract_all(body, {quoted(LINK)}, 1), lambda l: 'outlink: ' || {link} || {crlf}), '') AS outlinks,
         {digest("body")} AS payload_digest,
         {digest(f"'HTTP/1.1 200 OK' || {crlf} || h2 || {crlf} || h3 || {crlf} || {crlf} || body")} AS block_digest
  FROM decoded
), ids AS (
  SELECT *, {urn("'metadata' || chr(10) || record_id")} AS metadata_id, {urn("'conversion' || chr(10) || record_id")} AS conversion_id
  FROM parts
), records AS (
  SELECT page_id, 'metadata' AS record_type, metadata_id AS record_id, 'application/warc-fields' AS content_type, record_id AS refers_to, uri,
         'source-record-id: ' || record_id || {crlf} || 'source-payload-digest: ' || payload_digest || {crlf}
         || 'source-block-digest: ' || block_digest || {crlf} || 'source-header: HTTP/1.1 200 OK' || {crlf} || 'source-header: ' || h2 || {crlf}
         || 'source-header: ' || h3 || {crlf} || 'conversion-record-id: ' || conversion_id || {crlf}
         || 'conversion-digest: ' || {digest("text")} || {crlf} || CASE WHEN title <> '' THEN 'title: ' || title || {crlf} ELSE '' END || outlinks AS block
  FROM ids
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, 'text/plain; charset=utf-8', record_id, uri, text FROM ids
), sized AS (SELECT *, strlen(block) AS content_length, {digest("block")} AS block_digest FROM records)
SELECT page_id, record_type, record_id, content_type, block, refers_to, uri AS target_uri, content_length, block_digest,
       'WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
       || 'WARC-Refers-To: ' || refers_to || {crlf} || coalesce('WARC-Target-URI: ' || uri || {crlf}, '')
       || 'WARC-Date: {CAPTURED}' || {crlf} || 'WARC-Block-Digest: ' || block_digest || {crlf}
       || 'Content-Type: ' || content_type || {crlf} || 'Content-Length: ' || content_length || {crlf} AS header
FROM sized
"""


def _vocabulary() -> str:
    """The vocabulary's place on the machine that asks."""
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return token_attribution.attribute(docs, _vocabulary, public_tokenizers.PATTERN, fields=("source", "lang", "text"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality_trees.predict(docs, quality_trees.fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.read_back(chat.expand(turns.unionByName(extra)))


_OP5_TEXT = "coalesce(text, '')"
_OP5_ESCAPED = rf"length(regexp_replace({_OP5_TEXT}, '(<<|<|\[)(\\*)(/?(?:INST\]|s>|SYS>>|ROLE))', '\1\\\2\3', 'g'))"
OP5_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT conv_id, coalesce(role, '') AS role, {_OP5_TEXT} AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth,
         2 + {_OP5_ESCAPED} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                              ELSE 14 + 2 * strlen(coalesce(role, '')) END AS n
  FROM turns
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY nth) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY nth DESC) = 1 AS is_last
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR is_last), 0) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, profiles).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance"
    )


def op7_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut_lineage(mixing.measure(table(spark, sf_dir, "documents")))
    sources = mixing.plan_sources(measured, weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    mixed = mixing.repeat(measured, sources, mixing.choose(measured, sources))
    return mixed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1, mode=line_dedup.DROP_ALL)
    done = F.col(line_dedup.RESULT)
    return line_dedup.apply_bitmaps(docs, bitmaps).select(
        "doc_id",
        done["n_lines"].alias("n_lines"),
        done["n_dropped"].alias("n_dropped"),
        F.sha2(F.coalesce(done["kept_text"], F.lit("")), 256).alias("kept_sha256"),
    )


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return compression_bands.judge_learned(table(spark, sf_dir, "documents"), labels)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, table(spark, sf_dir, "benchmark"), importance.Rules(max_run=1, buckets=10_000, seed="2024", min_words=20, percent=10))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names neither owners nor repositories: a source stands for an owner, a document for a repository of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan(docs, owner_col="source", repo_col="doc_id")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_copied"
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.digest(conversation_repair.damage(turns), turns).drop("n_turns")


#: CRC-32 of a text in SQL: the table of bytes by the rule of its polynomial, and a fold over the text's bytes in hex.
_CRC_TABLE = """crc_table AS (
  SELECT list(CAST(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS BIGINT) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)
)"""


def _crc_of(text: str) -> str:
    fold = f"""list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT)),
        lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), 4294967295)"""
    return f"xor({fold}, 4294967295)"


OP11_SQL = rf"""
WITH {_CRC_TABLE}, words AS (
  SELECT doc_id, rid, unnest(w) AS word FROM (
    SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents)
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), coded AS (
  SELECT word, {_crc_of("word")} % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM wanted), crc_table
), s AS (SELECT bucket, count(*) AS s FROM words JOIN coded USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN coded USING (word) GROUP BY bucket
), totals AS (SELECT (SELECT count(*) FROM words) AS s_all, (SELECT count(*) FROM wanted) AS t_all
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (
  SELECT rid, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM words JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT doc_id, row_number() OVER () AS rid FROM documents) d LEFT JOIN weighed USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""

#: Kind, pattern, group of the secret, and its least length: every letter of a name in either case, written out.
_SECRETS = {
    "assign": (
        "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
        + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
    "private": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "prefixed": ("(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza|glpat-)[A-Za-z0-9_-]{16,}", 0, 1),
    "opaque": ("[A-Za-z0-9_-]+", 0, 24),
}


def _op12_sql() -> str:
    def of(k: int, pattern: str, group: int) -> str:
        return f"""SELECT rid, {k} AS k, unnest(string_split_regex(text, '{pattern}')) AS gap, unnest(regexp_extract_all(text, '{pattern}', 0)) AS found,
            unnest(regexp_extract_all(text, '{pattern}', {group})) AS secret, generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS nth FROM docs"""

    cut = " UNION ALL ".join(of(k, p, g) for k, (p, g, _) in enumerate(_SECRETS.values()))
    least = " ".join(f"WHEN {k} THEN {n}" for k, (*_, n) in enumerate(_SECRETS.values()))
    names = ", ".join(f"'{name}'" for name in _SECRETS)
    shown = f"([{names}])[k + 1] || ':' || a || ':' || b"
    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), cut AS ({cut}
), placed AS (
  SELECT rid, k, secret, sum(length(gap) + length(found)) OVER here AS b, sum(length(gap) + length(found)) OVER here - length(found) AS a
  FROM cut WHERE found IS NOT NULL WINDOW here AS (PARTITION BY rid, k ORDER BY nth)
), spans AS (
  SELECT *, doc_id, source FROM placed JOIN docs USING (rid)
  WHERE length(secret) >= CASE k {least} END AND (k <> 5 OR regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]')
        AND regexp_matches(secret, '[0-9]') AND len(list_distinct(string_split(secret, ''))) >= 12)
), owners AS (
  SELECT secret, count(DISTINCT {{'o': source}}) > 2 OR count(DISTINCT {{'o': source, 'd': doc_id}}) > 10 AS copied FROM spans GROUP BY secret
), listed AS (
  SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg({shown}, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base,
         string_agg({shown}, ',' ORDER BY a, k) FILTER (WHERE k < 3 OR NOT copied) AS spans,
         count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied
  FROM spans JOIN owners USING (secret) GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN listed USING (rid)
"""


#: Edit by edit: inserts are rows of their own, so a turn is one recursion for each way to it.
OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, cased AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS again
  FROM cased WHERE fate <> 0
), convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), sorted AS (
  SELECT conv, turn, role, text, role[1:1] AS c, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS nth
  FROM damaged d JOIN convs ON d.conv_id IS NOT DISTINCT FROM convs.conv_id
), faulty AS (
  SELECT *, CASE WHEN trim(text, {SPACES}) = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY nth) > 1 THEN 'd'
                 WHEN right(trim(text, {SPACES}), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(c) OVER (PARTITION BY conv ORDER BY nth) || c NOT IN ('su', 'ua', 'au') AS illegal
  FROM sorted
), facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM faulty GROUP BY conv
), goes(q, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(q, r, extra, more) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')
), edits AS (
  SELECT conv, nth, q, q AS r, 2 AS price, 'D' AS edit, '' AS line FROM faulty, (SELECT unnest([0, 1, 2, 3]) AS q)
  UNION ALL SELECT conv, nth, q, r, 5 * (fault = 't')::INT, 'K', role || ':' || text FROM faulty JOIN goes USING (c) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv, nth, q, r, 1 + 5 * (fault = 't')::INT, 'R', CASE goes.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
  FROM faulty, goes WHERE goes.c IN ('u', 'a') AND fault NOT IN ('b', 'd')
), made(r, more, lines) AS (VALUES (2, 'I', ['user:']), (3, 'I', ['assistant:']), (3, 'II', ['user:', 'assistant:']), (0, '', []), (1, '', []), (2, '', []), (3, '', [])
), path AS (
  SELECT conv, 0::BIGINT AS nth, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM convs
  UNION ALL
  SELECT p.conv, p.nth + 1, e.r, min({{'cost': p.best.cost + i.extra + e.price, 'audit': p.best.audit || i.more || e.edit,
         'lines': p.best.lines || m.lines || CASE e.edit WHEN 'D' THEN [] ELSE [e.line] END}})
  FROM path p JOIN inserts i USING (q) JOIN made m ON m.r = i.r AND m.more = i.more JOIN edits e ON e.conv = p.conv AND e.nth = p.nth + 1 AND e.q = i.r
  GROUP BY p.conv, p.nth, e.r
), ended AS (
  SELECT p.conv, min({{'cost': p.best.cost + i.extra, 'audit': p.best.audit || i.more, 'lines': p.best.lines || m.lines}}) AS best
  FROM path p JOIN inserts i USING (q) JOIN made m ON m.r = i.r AND m.more = i.more LEFT JOIN facts f USING (conv)
  WHERE p.nth = coalesce(f.n, 0) AND i.r IN (0, 3) GROUP BY p.conv
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM convs JOIN ended USING (conv) LEFT JOIN facts USING (conv)
"""


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {SPACES}), {UPPER_LOWER}) AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_derivatives": op1_warc_derivatives,
        "op2_token_attribution": op2_token_attribution,
        "op3_golay_simhash": op3_golay_simhash,
        "op4_quality_trees": op4_quality_trees,
        "op5_prefix_targets": op5_prefix_targets,
        "op6_rank_order_language": op6_rank_order_language,
        "op7_bm25_decontamination": op7_bm25_decontamination,
        "op8_source_mixing": op8_source_mixing,
        "op9_line_dedup": op9_line_dedup,
        "op10_compression_bands": op10_compression_bands,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_secret_ownership": op12_secret_ownership,
        "op13_turn_repair": op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_derivatives": _op1_sql(),
        "op5_prefix_targets": OP5_SQL,
        "op9_line_dedup": OP9_SQL,
        "op11_importance_resampling": OP11_SQL,
        "op12_secret_ownership": _op12_sql(),
        "op13_turn_repair": OP13_SQL,
    }
