"""Importance resampling against plain Python with zlib's CRC."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import importance
from millrace.llm.importance import Rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_features(text, max_run):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, rules):
    made = [plain_features(t, rules.max_run) for _, t in docs]
    s, t = np.zeros(rules.buckets, int), np.zeros(rules.buckets, int)
    for counts, rows in ((s, made), (t, [plain_features(x, rules.max_run) for x in target])):
        for _, crcs in rows:
            for crc in crcs:
                counts[crc % rules.buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + rules.buckets) / ((a + 1) * (t.sum() + rules.buckets)))) for a, b in zip(s, t)]
    rows = []
    for (doc_id, _), (n_words, crcs) in zip(docs, made):
        weight = sum(gain[c % rules.buckets] for c in crcs) // len(crcs) if crcs else 0
        h = int(hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n_words, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= rules.min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = fit[: len(fit) * rules.percent // 100]
    return rows, drawn


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("aZ9 é-\x00", max_size=40)), max_size=12), st.integers(1, 3), st.booleans())
def test_features_equal_zlib(texts, max_run, large):
    column = pa.array(["cut off", *texts], pa.large_string() if large else pa.string())[1:]
    found = [[] for _ in texts]
    for first, _, folded, offsets in importance.parts(column):
        for text, crc in importance.features(folded, offsets, max_run):
            for i, c in zip(text.tolist(), crc.tolist()):
                found[first + i].append(c)
    assert found == [plain_features(t, max_run)[1] for t in texts]


def test_long_words_and_small_parts(monkeypatch):
    monkeypatch.setattr(importance, "PART_BYTES", 50)
    texts = ["x" * 63, "y" * 64 + " z", "é" * 5000 + " Tail", "", "w" * 65]
    found = [(first + i, c) for first, _, folded, offsets in importance.parts(pa.array(texts)) for text, crc in importance.features(folded, offsets, 1) for i, c in zip(text.tolist(), crc.tolist())]
    assert found == [(i, c) for i, t in enumerate(texts) for c in plain_features(t, 1)[1]]


@pytest.mark.parametrize("rules", [Rules(min_words=3, percent=40), Rules(max_run=3, buckets=97, seed="a", min_words=0, percent=100), Rules()])
def test_rows_equal_plain_python(spark, documents, rules):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "X1"]
    docs = [(i if i % 9 else None, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, " \n"), (7, docs[7][1]), (7, docs[7][1]), (503, "w1 " * 50_000)]
    target = ["w1 w2 w3 w4", "w1 X1 ÉTÉ", None]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in importance.resample(documents(docs).repartition(5), items, rules).collect()]
    rows, drawn = plain(docs, target, rules)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted((r[:5] for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[:5] for r in ranked] == drawn


def test_ties_go_to_the_smaller_id_and_empty_tables(spark, documents):
    scored = spark.createDataFrame([(i, 20, 20, 0, 5) for i in range(50)] + [(i, 20, 20, 0, 9) for i in (70, 60)] + [(1, 19, 19, 0, 99)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["rank"]: r["doc_id"] for r in importance.draw(scored.repartition(7)).collect() if r["rank"]}
    assert got == {1: 60, 2: 70, 3: 0, 4: 1, 5: 2}
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(documents([]), none).count() == 0
    assert [r["rank"] for r in importance.resample(documents([(1, "a " * 30)] * 10), none).collect()].count(1) == 1


def test_odd_rows(odd_documents, spark):
    items = spark.createDataFrame([(1, "Same text")], "item_id long, text string")
    rows = importance.resample(odd_documents, items, Rules(min_words=1, percent=50)).collect()
    assert len(rows) == odd_documents.count()
    assert {r["doc_id"]: (r["n_features"], r["weight"]) for r in rows}[2] == (0, 0)
