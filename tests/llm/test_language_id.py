import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import language_id as L

WORDS = {"xx": ["kala", "mato", "wiri", "tano", "ku"], "yy": ["brich", "schtel", "dorf", "kranz", "ü"], "zz": ["слово", "дело", "мир"]}


def sample(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def brute_grams(text):
    counts = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            edged = f"\0{word}\0"
            counts.update(word)
            counts.update(edged[i : i + 2] for i in range(len(edged) - 1))
            counts.update(edged[i : i + 3] for i in range(len(edged) - 2))
            word = ""
    return counts


def number(gram):
    codes = [*map(ord, gram), L.ABSENT, L.ABSENT][:3]
    return codes[0] << 42 | codes[1] << 21 | codes[2]


def test_grams_equal_brute_force():
    for text in ["", "a", "Ab, cd!", "  été 12x\n\n中文 ", "x1y", "...", "a b c"]:
        assert Counter(L.grams(text).tolist()) == Counter({number(g): n for g, n in brute_grams(text).items()})


def test_profiles_and_distances_equal_brute_force(spark, documents):
    rng = random.Random(6)
    rows = [(i, sample(lang, rng), lang) for i, lang in enumerate(list(WORDS) * 10)]
    profiles = L.fit(documents(rows), size=20)
    ranks = {}
    for lang in WORDS:
        counts = Counter()
        for _, text, of in rows:
            if of == lang:
                counts += brute_grams(text)
        ordered = sorted(counts, key=lambda g: (-counts[g], number(g)))[:20]
        ranks[lang] = {g: i for i, g in enumerate(ordered)}
    assert profiles.langs == sorted(WORDS)
    for _, text, _ in rows[:6]:
        counts = brute_grams(text)
        top = sorted(counts, key=lambda g: (-counts[g], number(g)))[:20]
        want = [sum(abs(ranks[lang][g] - i) if g in ranks[lang] else 20 for i, g in enumerate(top)) / (20 * len(top)) for lang in sorted(WORDS)]
        assert profiles.distances(text) == pytest.approx(want)


def test_held_out_accuracy(spark, documents):
    rng = random.Random(8)
    train = documents([(i, sample(lang, rng), lang) for i, lang in enumerate(list(WORDS) * 10)])
    test = [(i, sample(lang, rng, 6), lang) for i, lang in enumerate(list(WORDS) * 20)]
    got = {r.doc_id: r for r in L.predict(documents(test), L.fit(train)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in test]) >= 0.98
    assert all(0 <= r.score <= 1 and 0 <= r.distance <= 1 for r in got.values())


def test_odd_rows_and_empty_tables(spark, odd_documents, documents):
    profiles = L.fit(odd_documents)
    rows = L.predict(odd_documents, profiles).collect()
    assert len(rows) == odd_documents.count() and profiles.langs == ["de", "en", "fr"]
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1, 2, 3))
    nothing = L.fit(documents([]))
    assert {r.lang_pred for r in L.predict(odd_documents, nothing).collect()} == {"und"}
    assert L.predict(documents([]), profiles).count() == 0
