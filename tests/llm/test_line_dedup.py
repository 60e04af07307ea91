import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup as L

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, mode):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    holders, first = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            if key(line):
                holders.setdefault(key(line), set()).add(doc)
                first.setdefault(key(line), (doc, pos))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for pos, x in enumerate(lines)
            if len(holders.get(key(x), ())) < min_docs or (mode == L.KEEP_FIRST and first[key(x)] == (doc, pos))
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("mode", [L.DROP_ALL, L.KEEP_FIRST])
def test_equals_brute_force(spark, documents, mode):
    rng = random.Random(3)
    pool = ["Common line", " common LINE\t", "", "  ", "a", "B", "b ", "Été", "été", *(f"rare {i}" for i in range(300))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 200])))) for i in range(40)]
    docs = documents(rows)
    done = L.apply_bitmaps(docs, L.keep_bitmaps(docs, min_docs=4, mode=mode))
    got = sorted((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept_text) for r in done.collect())
    assert got == brute(rows, 4, mode)


def test_odd_rows(spark, odd_documents):
    done = L.apply_bitmaps(odd_documents, L.keep_bitmaps(odd_documents, min_docs=2))
    rows = {(r.doc_id, r.text): r.line_dedup for r in done.collect()}
    assert done.count() == odd_documents.count() and set(done.columns) == set(odd_documents.columns)
    assert rows[5, "Same text here."].kept_text == "" and rows[5, "Same text here."].n_dropped == 1
    assert rows[1, None].n_lines == 1 and rows[1, None].kept_text is None
    assert rows[3, " \t\x0b\n\n"].n_lines == 3 and rows[3, " \t\x0b\n\n"].n_dropped == 0
    kept = L.apply_bitmaps(odd_documents, L.keep_bitmaps(odd_documents, min_docs=2, mode=L.KEEP_FIRST))
    same = {r.doc_id: r.line_dedup.kept_text for r in kept.where(F.col("text") == "Same text here.").collect()}
    assert same == {5: "Same text here.", 6: ""}


def test_empty_table_and_wrong_mode(spark, documents):
    docs = documents([])
    assert L.apply_bitmaps(docs, L.keep_bitmaps(docs)).count() == 0
    with pytest.raises(ValueError):
        L.keep_bitmaps(docs, mode="some")


def test_query_digest(spark, tmp_path, documents):
    from millrace.llm.queries import queries

    documents([(i, f"head\nbody {i}") for i in range(12)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_sha256 for r in rows} == {i: hashlib.sha256(f"body {i}".encode()).hexdigest() for i in range(12)}
