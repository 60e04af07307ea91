import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from millrace.llm import shingle_copies as S


def shingles(text):
    words = re.findall(r"\S+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_edited_copies_go_and_less_similar_texts_stay(spark, documents):
    rng = random.Random(5)
    rows, near, far = [], set(), set()
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((i, " ".join(words)))
        for base, places, ids in ((1000, (30, 80), near), (2000, (20, 40, 60, 80, 100), far)):
            edited = list(words)
            for p in places:
                edited[p] = "changed"
            rows.append((base + i, " ".join(edited)))
            ids.add(base + i)
    text = dict(rows)
    assert all(jaccard(text[i - 1000], text[i]) >= 0.8 for i in near) and all(jaccard(text[i - 2000], text[i]) < 0.8 for i in far)
    kept = {r.doc_id for r in C.near_copies(spark, documents(rows), "").collect()}
    linked_far = {i for i in far if jaccard(text[i], text[i - 1000]) >= 0.8}
    assert not linked_far and not near & kept and far <= kept and set(range(60)) <= kept


def test_texts_of_null_and_equal_ids_are_judged_each(spark, documents):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    docs = documents([(1, a), (None, b), (None, c), (None, c), (7, d), (7, a), (8, d)])
    got = sorted((r.doc_id or 0, r.text) for r in C.near_copies(spark, docs, "").collect())
    assert got == sorted([(1, a), (0, b), (0, c), (7, d)])


def variants(rng, base, n, most):
    """Texts of a base with a random number of its words changed, so that their similarities spread widely about 0.8."""
    out = []
    for _ in range(n):
        words = list(base)
        for p in rng.sample(range(len(words)), rng.randrange(most)):
            words[p] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def groups(texts):
    """Components of all pairs with Jaccard 0.8 or more, as the least id of each text, and the number of such pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    found = 0
    for i in texts:
        for j in texts:
            if i < j and len(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                found += 1
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root, found


@pytest.fixture(scope="module")
def large_group():
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = variants(rng, base, 400, 9) + variants(rng, base[:75] + [f"v{i}" for i in range(75)], 120, 7) + variants(rng, [f"u{i}" for i in range(9)], 12, 2)
    rows = dict(enumerate(texts)) | {1000 + i: texts[i] for i in range(0, 400, 3)}
    return rows, groups(rows)


@pytest.mark.parametrize("sizes", [{}, {"tile": 16}, {"tile": 64, "cell_shingles": 9_000}, {"cell_shingles": 100}])
def test_large_groups_equal_brute_force_whatever_the_tiles_and_parts(spark, documents, large_group, sizes):
    rows, (root, found) = large_group
    assert found > 10_000 and len(set(root.values())) > 60
    docs = documents(list(rows.items())).withColumn("text_hash", C.text_hash(F.col("text")))
    kept = {r.doc_id for r in S.near_copies(docs, **sizes).where("keeps").collect()}
    want = set(root.values())
    assert want <= kept  # no group is lost
    assert len(kept - want) <= 0.01 * (len(rows) - len(want))


def test_all_texts_of_one_fingerprint_are_compared(spark, documents):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    other = " ".join(f"o{i}" for i in range(80))
    texts = [other, " ".join(base), " ".join([*base[:-1], "end"])]
    docs = documents(list(enumerate(texts))).withColumn("text_hash", C.text_hash(F.col("text")))
    made = S.sketches(docs)
    least = made.orderBy("node").first()["node"]
    # All three go by the fingerprint of one; the least node need not be of the similar two.
    same = made.crossJoin(made.where(F.col("node") == least).select(F.col("fp").alias("f"))).withColumn("fp", F.col("f")).drop("f")
    names = {r.node: r.doc_id for r in made.collect()}
    (link,) = S.links(same, docs).collect()
    assert {names[link.a], names[link.b]} == {1, 2}


def test_a_group_in_parts_hands_on_few_links():
    rng = random.Random(10)
    base = [f"w{i}" for i in range(100)]
    texts = variants(rng, base, 200, 3)
    batch = pa.RecordBatch.from_pydict({"cloud": [1] * 200, "at": [0] * 200, "passes": [i >= 120 for i in range(200)], "node": list(range(200)), "text": texts})
    pairs = [p for b in S._compared(iter([batch])) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    assert len(pairs) < 400 and {n for p in pairs for n in p} == set(range(200))
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in pairs)
