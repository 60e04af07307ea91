import base64
import math
import random

import zstandard

from millrace.llm import compression_bands as C


def test_noise_of_several_lengths_is_rejected_whole_and_in_part(spark, documents):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def of(make, n):
        text = ""
        while len(text) < n:
            text += make() + " "
        return text[:n]

    def prose(n):
        return of(lambda: rng.choice(words), n)

    noises = (
        lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))),
        lambda: rng.randbytes(3).hex(),
        lambda: base64.b64encode(rng.randbytes(6)).decode(),
    )
    good = [(i, prose(n)) for i, n in enumerate([1500, 3000, 5000, 7000, 20000] * 30)]
    bad = [of(make, n) for make in noises for n in (3000, 7000, 20000)]
    bad += [prose(8000) + of(noises[2], 12000), prose(3000) + of(noises[0], 6000)]
    docs = documents(good + bad_rows(bad))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.judge_learned(docs, labels).collect()}
    kept = {i for i, r in got.items() if r.kept}
    failed = {i for i, r in got.items() if r.base_failed}
    assert kept == {i for i, _ in good} and not {i for i, _ in bad_rows(bad)} & failed


def bad_rows(bad):
    return [(1000 + i, t) for i, t in enumerate(bad)]


def drone(rng, words, n):
    """Text that says little: a few words over and over, though never a window of three words twice in a row."""
    few = rng.sample(words, 40)
    text = ""
    while len(text) < n:
        text += " ".join(rng.sample(few, 6)) + " "
    return text[:n]


def brute_verdicts(rows, good_ids, bands):
    """The verdicts from plain lists: every ratio, every class's ends, every document."""
    compress = zstandard.ZstdCompressor(level=bands.level).compress
    ratio = lambda raw: len(compress(raw)) / len(raw)
    of_size = lambda n: math.floor(2 * math.log2(n))
    pieces = {}
    for i, text in rows:
        raw, n = text.encode(), bands.chunk_bytes
        cut = [raw[a : a + n] for a in range(0, len(raw), n)]
        if len(cut) > 1 and len(cut[-1]) < n // 2:
            cut[-2:] = [cut[-2] + cut[-1]]
        pieces[i] = (raw, cut if len(cut) > 1 else [])
    ends = {}
    for kind in (0, 1):
        seen = {}
        for i in good_ids:
            for piece in [pieces[i][0]] if kind == 0 else pieces[i][1]:
                seen.setdefault(of_size(len(piece)), []).append(ratio(piece))
        for size, found in seen.items():
            if len(found) >= C.LEARNED_TEXTS:
                found.sort()
                at = lambda q, found=found: found[max(0, math.ceil(q * len(found)) - 1)]
                ends[kind, size] = (at(C.LEARNED_TAIL), at(1 - C.LEARNED_TAIL))

    def within(piece, kind):
        sizes = sorted(s for k, s in ends if k == kind)
        longer = [ends[kind, s][0] - C.LEARNED_BELOW for s in sizes if s >= of_size(len(piece))]
        shorter = [ends[kind, s][1] + C.LEARNED_ABOVE for s in sizes if s <= of_size(len(piece))]
        fixed = bands.limits(len(piece)) if kind == 0 else bands.chunk
        r = ratio(piece)
        return fixed[0] <= r <= fixed[1] and (not longer or min(longer) <= r) and (not shorter or r <= shorter[-1])

    out = {}
    for i, (raw, chunks) in pieces.items():
        bad = sum(len(c) for c in chunks if not within(c, 1))
        out[i] = within(raw, 0) and bad <= bands.max_bad_share * len(raw)
    return out


def test_verdicts_equal_brute_force_and_catch_repetition(spark, documents):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    lengths = [700, 1500, 3000, 5000, 9000]

    def prose(n):
        text = ""
        while len(text) < n:
            text += rng.choice(words) + " "
        return text[:n]

    good = [(i, prose(n)) for i, n in enumerate(lengths * 30)]
    dull = [(1000 + i, drone(rng, words, n)) for i, n in enumerate(lengths * 6)]
    half = [(2000 + i, prose(n) + drone(rng, words, n)) for i, n in enumerate([3000, 5000, 9000] * 4)]
    rows = good + dull + half
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.judge_learned(documents(rows), labels).collect()}
    passed = {i for i, r in got.items() if not r.base_failed}
    want = brute_verdicts([r for r in rows if r[0] in passed], [i for i, _ in good if i in passed], C.Bands())
    assert {i: got[i].kept for i in passed} == want
    assert all(got[i].kept for i, _ in good)
    caught = [not got[i].kept for i, _ in dull + half if i in passed]
    assert len(caught) > 30 and sum(caught) >= 0.9 * len(caught)


def test_without_good_texts_the_fixed_bands_hold(spark, documents, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fixed = sorted(map(tuple, C.judge(odd_documents).collect()), key=str)
    assert sorted(map(tuple, C.judge_learned(odd_documents, none).collect()), key=str) == fixed
    assert C.judge_learned(documents([]), none).count() == 0
