import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import golay, simhash
from millrace.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps):
    """Least id reachable, by breadth-first search over all pairs."""
    ids = sorted(fps)
    near = {i: [j for j in ids if (fps[i] ^ fps[j]).bit_count() <= 3] for i in ids}
    out = {}
    for i in ids:
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def test_golay_code_is_the_extended_one():
    parity, leaders, number = golay.tables()
    words = [info << 12 | int(parity[info]) for info in range(4096)]
    weights = {w.bit_count() for w in words}
    assert weights == {0, 8, 12, 16, 24}
    assert set(number.tolist()) == {1, 6} and (number == 6).sum() == 1771


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**24 - 1), st.integers(0, 23))
def test_neighbours_share_a_codeword(word, bit):
    row, name = golay.near_codewords(np.array([word, word ^ 1 << bit], np.int64))
    assert set(name[row == 0]) & set(name[row == 1])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_linked_fingerprints_share_a_key(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    row, key = simhash.keys_of(np.array([fp, other], np.uint64))
    assert set(key[row == 0]) & set(key[row == 1])


def test_fingerprints_equal_brute_force():
    rng = random.Random(5)
    texts = ["", None, " \n", "One", "Two words", "Three little Words", "ÉA b\x0bc d É a"]
    texts += [" ".join(rng.choice(["Aa", "b", "É", "中"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("tile", [3, simhash.TILE])
def test_components_equal_brute_force(spark, tile, monkeypatch):
    """Dense clusters, chains and lone fingerprints; with tiny tiles every key is met tile by tile."""
    rng = random.Random(7)
    fps = {}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps[len(fps)] = x
    x = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        fps[len(fps)] = x
    for _ in range(50):
        fps[len(fps)] = rng.getrandbits(64)
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda df: real(df, tile))
    ids = list(fps)
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, fps[i] - (1 << 64) * (fps[i] >> 63)) for i in ids], "doc_id long, fp long").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.components_of(df).collect()}
    assert got == brute_components(fps)


def test_spanning_links_connect_the_same():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = np.unique(np.array([base ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)], np.uint64))
    found = [pair for a, b in simhash.spanning_links(fps) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    assert all((a ^ b).bit_count() <= 3 for a, b in found) and len(found) < len(fps)


def test_odd_rows_and_empty_table(spark, odd_documents, documents):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd_documents).collect()}
    assert simhash.near_duplicates(odd_documents).count() == odd_documents.count()
    assert rows[1, 0] == rows[2, 0] == rows[3, 0] == 1
    same = {c for (doc, _), c in rows.items() if doc in (5, 6)}
    assert same == {5}
    assert simhash.near_duplicates(documents([])).count() == 0


def test_components_of_plain_graphs(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 10), (4, 4), (None, 5), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 260))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 9, 10: 9, **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 261), 200)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_are_within_three_bits_only():
    for bits in combinations(range(0, 64, 13), 4):
        fps = np.array([0, sum(1 << b for b in bits)], np.uint64)
        assert not list(simhash.spanning_links(fps))
