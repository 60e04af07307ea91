"""WARC derivatives: for each response record a linked metadata and a plain-text conversion record.

Both name the response in WARC-Refers-To and carry its target URI and date. The metadata record keeps
the response's identifier, HTTP headers and digests, its title and its links; the conversion record is
the page's text. Identifiers are drawn from hashes of the response's own, so a rerun after a lost
executor writes the same records. Every row is built on its own: nothing is shuffled.

Text extraction: comments, titles, scripts, styles, templates and unfinished tags go, block-level tags
become line ends, other tags vanish, character references are decoded once as the HTML standard has it (all of
its names, the older ones also without a semicolon and as the start of a longer word; numbers of any length,
128 to 159 as windows-1252), and white space is squeezed within lines.

Cases, all defined: a null or empty body gives records with an empty text; a null URI leaves its headers
out; a null date or header block is left empty. Line ends in a URI are percent-encoded, since headers
are lines. Repeated rows give repeated records. Numeric references to no character become U+FFFD;
unknown names stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: What extraction takes out, first to last. They read alike in Java's and RE2's syntax.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
SILENT = "|".join(
    rf"{tag}\b[^>]*>.*?(?:</{tag}[ \t\r\n\f]*>|\z)" for tag in ("script", "style", "noscript", "template", "title")
)
SILENT = f"(?is)<(?:{SILENT})"
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    r"h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)
INLINE_TAG = r"<[A-Za-z/!?][^>]*(?:>|\z)"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title[ \t\r\n\f]*>"
LINK = r"""(?i)<a\b[^>]*?\bhref[ \t\r\n\f]*=[ \t\r\n\f]*["']([^"'>]*)["']"""
NUMBER = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+)"
NAME = r"^[A-Za-z][A-Za-z0-9]*;?"
#: Longer than any name.
LONGEST_NAME = 40
SPACES = r"[ \t\x0B\f\r\x{A0}]+"
LINE_ENDS = r" ?\n[ \n]*"
#: Named references, from the standard library's HTML 5 table, by their first letter; with the semicolon that ends them, but for
#: some older names that also stand without.
NAMED = [{name: text for name, text in sorted(html5.items()) if name[0] == chr(code)} for code in range(ord("A"), ord("z") + 1)]
OLDER = "^(?:" + "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))) + ")"
#: Numbers that stand for what the code page windows-1252 has in their place.
WINDOWS_1252 = [ord(bytes([code]).decode("cp1252", "ignore") or chr(code)) for code in range(0x80, 0xA0)]


def _character(digits: Column, base: int) -> Column:
    """The character of a numeric reference, whatever its number of digits."""
    significant = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.char_length(significant) <= 8, F.least(F.conv(significant, base, 10).cast("long"), F.lit(0x110000).cast("long")))
    windows = F.from_json(F.lit(json.dumps(WINDOWS_1252)), "array<int>")
    code = F.coalesce(F.get(windows, (code - 0x80).cast("int")).cast("long"), code)
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    four_bytes = F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0"))
    return F.decode(four_bytes, "UTF-32")


def split_references(text: Column) -> Column:
    """What stands before the first ``&``, and after each the reference that it begins, if any."""
    head = F.struct(F.lit("").alias("ref"), F.lit("").alias("rest"))
    pieces = F.split(text, "&", -1)

    def read(piece: Column) -> Column:
        number = F.regexp_extract(piece, NUMBER, 0)
        found = F.when(piece.startswith("#"), number).otherwise(F.regexp_extract(piece.substr(1, LONGEST_NAME), NAME, 0))
        return F.struct(found.alias("ref"), piece.alias("rest"))

    return F.when(text.contains("&"), F.transform(pieces, read)).otherwise(
        F.array(F.struct(head["ref"].alias("ref"), text.alias("rest")))
    )


def join_references(parts: Column) -> Column:
    """The text of split_references() with its references replaced by their characters, each once."""
    tables = F.from_json(F.lit(json.dumps(NAMED)), "array<map<string,string>>")

    def named(name: Column) -> Column:
        return F.try_element_at(F.get(tables, F.ascii(name) - ord("A")), name)

    def decoded(part: Column, i: Column) -> Column:
        ref, rest = part["ref"], part["rest"]
        size, older = F.char_length(ref), F.regexp_extract(ref, OLDER, 0)
        after = size + 1 + (rest.substr(size + 1, F.lit(1)) == ";").cast("int")
        number = F.when(F.lower(ref.substr(2, 1)) == "x", _character(ref.substr(F.lit(3), size), 16)).otherwise(_character(ref.substr(F.lit(2), size), 10))
        return (
            F.when(i == 0, rest)
            .when(ref.startswith("#"), F.concat(number, rest.substr(after, F.char_length(rest))))
            .when(named(ref).isNotNull(), F.concat(named(ref), rest.substr(size + 1, F.char_length(rest))))
            .when(older != "", F.concat(named(older), rest.substr(F.char_length(older) + 1, F.char_length(rest))))
            .otherwise(F.concat(F.lit("&"), rest))
        )

    return F.array_join(F.transform(parts, decoded), "")


def untagged(html: Column) -> Column:
    silent = F.regexp_replace(F.regexp_replace(html, COMMENT, ""), SILENT, "")
    return F.regexp_replace(F.regexp_replace(silent, BLOCK_TAG, "\n"), INLINE_TAG, "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, SPACES, " "), LINE_ENDS, "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    return squeezed(join_references(split_references(untagged(html))))


def record_urn(*parts: Column) -> Column:
    """``<urn:uuid:...>`` with a name-based identifier drawn from a hash of the parts."""
    h = F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    uuid = F.concat_ws(
        "-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(F.lit("8"), h.substr(18, 3)), h.substr(21, 12)
    )
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of ``page_id, url, html``: ``key, record_id, target_uri, date, http_headers, body``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF)
    )
    return pages.select(
        F.col("page_id").alias("key"),
        record_urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        body.alias("body"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def derive(found: DataFrame) -> DataFrame:
    """Two records for each row of responses(): ``key, record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, header, block``."""
    body = F.coalesce(F.col("body"), F.lit(""))
    uri = F.replace(F.replace(F.col("target_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    title = F.trim(F.regexp_replace(join_references(F.col("title")), r"[ \t\r\n\f]+", " "))
    outlinks = F.transform(
        F.regexp_extract_all(body, F.lit(LINK), F.lit(1)),
        lambda link: F.concat(F.lit("outlink: "), F.regexp_replace(F.replace(link, F.lit("&amp;"), F.lit("&")), "[\r\n]+", ""), F.lit(CRLF)),
    )
    http = F.coalesce(F.col("http_headers"), F.lit(""))
    # One projection for each step: an expression that the next step reads twice is still computed once.
    read = found.select(
        "key", "record_id", "date", uri.alias("uri"), http.alias("http"), untagged(body).alias("text"),
        F.regexp_extract(body, TITLE, 1).alias("title"), F.array_join(outlinks, "").alias("outlinks"),
        _digest(body).alias("payload_digest"), _digest(F.concat(http, F.lit(CRLF), body)).alias("block_digest"),
        record_urn(F.lit("metadata"), F.col("record_id")).alias("metadata_id"),
        record_urn(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
    )
    split = read.withColumns({c: split_references(F.col(c)) for c in ("text", "title")})
    parts = split.withColumns({"text": join_references(F.col("text")), "title": title}).withColumn("text", squeezed(F.col("text")))
    source_headers = F.concat(F.lit("source-header: "), F.regexp_replace(F.regexp_replace("http", "[\r\n]+$", ""), "\r\n", "\r\nsource-header: "), F.lit(CRLF))
    metadata = F.concat(
        _field("source-record-id", F.col("record_id")),
        _field("source-payload-digest", F.col("payload_digest")),
        _field("source-block-digest", F.col("block_digest")),
        F.when(F.col("http") != "", source_headers).otherwise(""),
        _field("conversion-record-id", F.col("conversion_id")),
        _field("conversion-digest", _digest(F.col("text"))),
        _field("title", F.when(F.col("title") != "", F.col("title"))),
        F.col("outlinks"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    each = parts.select("key", F.col("record_id").alias("refers_to"), "date", "uri", F.explode(kinds).alias("r")).select(
        "key", "r.*", "refers_to", F.col("uri").alias("target_uri"), "date",
        F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"),
    )
    header = F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")),
        _field("Content-Length", F.col("content_length").cast("string")),
    )
    return each.withColumn("header", header).drop("date")


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files: header, empty line, block, and two line ends after each."""
    whole = records.select(F.concat("header", F.lit(CRLF), "block").alias("value"))
    whole.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)
