"""Alignment against the standard library's matcher, and spans through revisions against its opcodes."""

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import alignment as A
from millrace.operators import state

TEXT = st.text("ab é\U0001f600", max_size=30)


def plain_blocks(a, b):
    return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


@pytest.mark.parametrize("small", [0, 250_000])
@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_blocks_and_edits_equal_the_matcher(small, a, b):
    kept, A.SMALL = A.SMALL, small
    try:
        assert A.matching_blocks(a, b) == plain_blocks(a, b)
        assert list(A.opcodes(a, b)) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    finally:
        A.SMALL = kept


def test_longer_texts_equal_the_matcher():
    rng = random.Random(1)
    for _ in range(6):
        a = "".join(rng.choice("abcd ") for _ in range(1500))
        b = list(a)
        for _ in range(rng.randrange(1, 30)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(4)] = rng.choice(["", "x", "ab", "cd cd"])
        assert A.matching_blocks(a, "".join(b)) == plain_blocks(a, "".join(b))


def test_a_hundred_thousand_characters_take_seconds():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    a = " ".join(rng.choice(words) for _ in range(17_000))[:100_000]
    b = a[:30_000] + "an insertion " + a[30_000:70_000] + a[70_200:]
    start = time.perf_counter()
    blocks = A.matching_blocks(a, b)
    assert time.perf_counter() - start < 10
    assert sum(k for *_, k in blocks) >= 99_700 and all(a[i : i + k] == b[j : j + k] for i, j, k in blocks)


def plain_ambiguous(texts, word, at):
    """The places by the matcher's opcodes, text by text."""
    places, touched, out = {at}, False, []
    find = lambda t, p: [i for i in range(len(t) - len(p) + 1) if t.startswith(p, i)]
    for nth, text in enumerate(texts):
        if nth and places:
            old, new_places = texts[nth - 1], set()
            ops = SequenceMatcher(None, old, text, autojunk=False).get_opcodes()
            for s in places:
                e = s + len(word)
                block = [o for o in ops if o[0] == "equal" and o[1] <= s and e <= o[2]]
                if block:
                    same = old[block[0][1] : block[0][2]]
                    certain = len(find(old, same)) == len(find(text, same)) == 1
                    touched |= not certain
                    new_places |= {i + s - block[0][1] for i in find(text, same)}
                    continue
                touched = True
                hit = [o for o in ops if max(s, o[1]) < min(e, o[2]) or (o[1] == o[2] and s < o[1] < e)]
                if hit:
                    low, high = min(o[3] for o in hit), max(o[4] for o in hit)
                    near = [i for i in find(text, word) if (i < high and i + len(word) > low if low < high else i < low < i + len(word))]
                    new_places |= set(near) if len(near) == 1 else set()
            places = {i for i in new_places if text[i : i + len(word)] == word}
        out.append((nth, touched, sorted(places) if touched else []))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=14), min_size=1, max_size=5))
def test_ambiguous_places_equal_the_opcodes(texts):
    words = texts[0].split()
    step, held = state.follow_ambiguous(), {}
    got = [step(held, (i, t)) for i, t in enumerate(texts)]
    if words:
        assert got == plain_ambiguous(texts, words[0], texts[0].find(words[0]))
    else:
        assert all(g == (i, False, []) for i, g in enumerate(got))
