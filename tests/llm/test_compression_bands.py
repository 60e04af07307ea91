import base64
import random
import re
from collections import Counter

from millrace.llm import compression_bands as C


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts_equal_brute_force(spark, documents, odd_documents):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab#cdeé") * rng.randint(1, 2) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts += ["x y\nx y\n\n \nx  y\nx y", "a\x0bb\x0cc d", "a a a a"]
    for docs in (documents(list(enumerate(texts))), odd_documents):
        want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect() if r.doc_id is not None)
        got = C.judge(docs).collect()
        assert len(got) == docs.count()
        assert sorted(tuple(r)[:7] for r in got if r.doc_id is not None) == want
        assert not any(r.kept and r.base_failed for r in got)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark, documents):
    rng = random.Random(2)
    syllables = ["the", "ing", "ou", "er", "tion", "an", "sh", "re", "bl", "ea", "st", "nd", "ha"]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(300))
    lists = "\n".join(f"item {i} of the very same list that never ends" for i in range(400))
    half = prose[:3000] + "\n" + "\n".join(f"{i} spam spam spam spam spam spam {i}" for i in range(300))
    docs = documents([(1, prose), (2, noise), (3, lists), (4, half), (5, "")])
    got = {r.doc_id: r for r in C.judge(docs).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[4].kept and not got[5].kept
    assert got[4].bad_chunk_share > 0.5 or got[4].whole_ratio < 0.3 or got[4].base_failed


def test_limits_by_length():
    bands = C.Bands()
    assert bands.limits(0) == (0.30, 1.05) and bands.limits(512) == (0.30, 0.90) and bands.limits(10**7) == (0.20, 0.65)


def test_empty_table(spark, documents):
    assert C.judge(documents([])).count() == 0
