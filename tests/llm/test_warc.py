import hashlib
import html
import random
import re
from html.entities import html5
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.queries import oracle_sql, queries


def text_of(spark, *pages):
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    return [r[0] for r in df.select(warc.plain_text(F.col("h"))).collect()]


class Reader(HTMLParser):
    """The standard library's parser as an independent reading of plain pages."""

    BLOCK = {"p", "div", "li", "ul", "h1", "body", "html", "nav", "article", "footer", "br", "td", "tr", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "title")
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "title")
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def parsed(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    text = re.sub(r"[ \t\x0b\f\r\xa0]+", " ", "".join(reader.out))
    return re.sub(r" ?\n[ \n]*", "\n", text).strip(" \n")


PAGES = [
    "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>Caf&eacute; &lt;b&gt; &#233;&#x1F600;</p><p>two<br>lines</p></body></html>",
    "<script>var a='<p>no</p>';</script>kept <i>in</i>line<!-- <p>gone</p> --> end",
    "<ul><li>one</li><li>two &nbsp; three</li></ul><table><tr><td>a</td><td>b</td></tr></table>",
]


def test_text_equals_the_standard_parser(spark):
    assert text_of(spark, *PAGES) == [parsed(p) for p in PAGES]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a &amp;lt; b", "a &lt; b"), ("&unknown; &amp", "&unknown; &"), ("&#0; &#55296; &#1114112;", "� � �"),
        ("x < y and a<b", "x < y and a"), ("open <p", "open"), ("<script>never closed", ""), ("&#x41;&#66;", "AB"), ("&", "&"), ("", ""),
        ("&#0000000065;&#x0000041;x&#65", "AAxA"), ("&check;&NotEqualTilde;&acE;", "✓≂̸∾̳"), ("&notit; &copyright &ampx", "¬it; ©right &x"), ("&#150;&#x80;&#129;|", "–€\x81|"),
        ("&#99999999999999999999; &#xFFFFFFFF;&#x;&#;", "\ufffd \ufffd&#x;&#;"), ("&" + "a" * 60 + ";", "&" + "a" * 60 + ";"),
    ],
)
def test_edges(spark, page, text):
    assert text_of(spark, page) == [text]


def records(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS body", "3 AS text")
    return warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z")).collect()


def test_records_are_linked_and_digested(spark):
    rows = [(1, "http://a/x", PAGES[0] + '<a href="/l?a=1&amp;b=2">x</a>'), (2, None, None), (3, "http://b/\r\ny", "<p>z")]
    got = records(spark, rows)
    assert len(got) == 6 and len({r.record_id for r in got}) == 6
    by = {(r.key, r.record_type): r for r in got}
    for key in (1, 2, 3):
        meta, text = by[key, "metadata"], by[key, "conversion"]
        assert meta.refers_to == text.refers_to and f"conversion-record-id: {text.record_id}\r\n" in meta.block
        assert f"source-record-id: {meta.refers_to}\r\n" in meta.block
        for r in (meta, text):
            assert r.content_length == len(r.block.encode())
            assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
            assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
            assert "\n" not in r.header.replace("\r\n", "")
    body = rows[0][2]
    meta = by[1, "metadata"].block
    assert "source-payload-digest: sha256:" + hashlib.sha256(body.encode()).hexdigest() in meta
    assert "title: T & U\r\n" in meta and "outlink: /l?a=1&b=2\r\n" in meta and "source-header: Content-Type: text/html" in meta
    assert by[2, "conversion"].block == "" and "WARC-Target-URI" not in by[2, "conversion"].header


def test_written_files_parse_as_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGES[0]), (2, "http://b/", PAGES[2])], "page_id long, url string, html string")
    warc.write(warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z")).coalesce(1), f"{tmp_path}/w", "none")
    (file,) = tmp_path.glob("w/part-*")
    data, seen = file.read_bytes(), []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert "sha256:" + hashlib.sha256(data[:n]).hexdigest() == fields["WARC-Block-Digest"] and data[n : n + 4] == b"\r\n\r\n"
        seen.append(fields["WARC-Type"])
        data = data[n + 4 :]
    assert sorted(seen) == ["conversion", "conversion", "metadata", "metadata"]


def test_repeated_rows_and_empty_table(spark):
    assert len(records(spark, [(1, "u", "x")] * 3)) == 6
    assert records(spark, []) == []


def test_references_equal_the_standard_library(spark):
    """Random mixtures of references, whole and broken, against html.unescape."""
    rng = random.Random(1)
    names = sorted(html5)
    odd = {c for c in range(0x110000) if not html.unescape(f"&#{c};")}  # the library drops these, the standard does not

    def reference():
        kind = rng.randrange(4)
        if kind == 0:
            return "&" + rng.choice(names)
        if kind == 1:
            return "&" + rng.choice(names)[: rng.randint(1, 6)] + rng.choice(["", ";", "x;", " "])
        code = rng.choice([rng.randrange(256), rng.randrange(0x11000), 10 ** rng.randint(5, 30)])
        code = 65 if code in odd else code
        return ("&#" + "0" * rng.randint(0, 9) + str(code) if kind == 2 else f"&#{rng.choice('xX')}{'0' * rng.randint(0, 9)}{code:x}") + rng.choice(["", ";"])

    texts = ["".join(rng.choice(["q", " ", "&", ";", reference(), reference()]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(warc.join_references(warc.split_references(F.col("t")))).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_sql_agrees_on_hard_pages(spark, tmp_path):
    hard = ["a &#0000000065; &check; &notit; <b>x</b>&#150;<p>y", "<title>T &lt; U</title><style>.a{}</style><SCRIPT>x</script >z<!-- c", "<template>t</template>&#xD800;&#1114112;&", None, ""]
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(hard + PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    mine = sorted(tuple(r[c] for c in ("page_id", "record_type", "block", "header")) for r in queries()["op1_warc_derivatives"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert mine == sorted(con.execute(f"SELECT page_id, record_type, block, header FROM ({oracle_sql()['op1_warc_derivatives']})").fetchall())
