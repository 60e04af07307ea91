import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import token_attribution as A

PATH = str(P.path("byte_bpe_50k.tiktoken"))


def brute(lengths, section_lengths, rule):
    """Character by character: whose is it, and of which token."""
    owner = [s for s, n in enumerate(section_lengths) for _ in range(n)]
    counts, crossing, shares = ([0] * len(section_lengths) for _ in range(3))
    at = 0
    for n in lengths:
        held = owner[at : at + n]
        at += n
        most = held[0] if rule == A.FIRST else max(sorted(set(held)), key=lambda s: (held.count(s), -s))
        counts[most] += 1
        for s in set(held):
            shares[s] += held.count(s) / n
            crossing[s] += len(set(held)) > 1
    return counts, crossing, shares


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=20), st.data(), st.sampled_from([A.FIRST, A.MAJORITY]))
def test_allocation_equals_counting_characters(lengths, data, rule):
    left, sections = sum(lengths), []
    while left:
        sections.append(data.draw(st.integers(0, left)))
        left -= sections[-1]
    sections = sections or [0]
    ends = np.cumsum(np.array(lengths, np.int64))
    got = A.allocate(ends - np.array(lengths, np.int64), ends, np.cumsum(sections), rule)
    for mine, theirs in zip(got, brute(lengths, sections, rule), strict=True):
        assert list(mine) == pytest.approx(theirs)


@pytest.mark.parametrize("rule", [A.FIRST, A.MAJORITY])
def test_sections_add_up_to_the_document(spark, documents, rule):
    encoding, lengths = A.encoder(PATH, P.PATTERN)
    rows = [(1, "One line\n\n\nétait 中文 \U0001f600\nlast", "fr", "web"), (2, "", "en", "b"), (3, "\n", "en", "c"), (4, "x" * 5000 + "\n" + "y z " * 3000, "en", "d")]
    docs = documents(rows)
    out = A.attribute(docs, PATH, P.PATTERN, ("source", "lang", "text"), rule=rule).toPandas()
    for doc, text, lang, source in rows:
        whole = f"{source} {lang} {text}"
        tokens = encoding.encode_ordinary(whole)
        mine = out[out.doc_id == doc].sort_values("section")
        assert mine.n_tokens.sum() == len(tokens) == mine.doc_tokens.iloc[0]
        assert mine.token_share.sum() == pytest.approx(len(tokens))
        assert "".join(whole[a:b] for a, b in zip(mine.char_start, mine.char_end, strict=True)) == whole
        assert len(mine) == 2 + len(text.split("\n"))
    assert sum(lengths[encoding.encode_ordinary("é中\U0001f600")]) == len("é中\U0001f600".encode())


def test_crossing_tokens_follow_the_rule(spark, documents):
    docs = documents([(1, "x", "en", "web")])
    first = A.attribute(docs, PATH, P.PATTERN, ("source", "lang"), rule=A.FIRST).toPandas()
    most = A.attribute(docs, PATH, P.PATTERN, ("source", "lang"), rule=A.MAJORITY).toPandas()
    assert first.n_tokens.tolist() == [2, 0] and most.n_tokens.tolist() == [1, 1]
    assert first.n_crossing.tolist() == [1, 1] and most.token_share.tolist() == pytest.approx([4 / 3, 2 / 3])


def test_odd_rows_empty_table_and_wrong_rule(spark, odd_documents, documents):
    out = A.attribute(odd_documents, PATH, P.PATTERN).toPandas()
    assert out[out.doc_id == 1].n_tokens.tolist() == [0] and out[out.doc_id == 2].n_tokens.tolist() == [0]
    assert len(out[out.doc_id == 5]) == 2
    assert A.attribute(documents([]), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        A.attribute(odd_documents, PATH, P.PATTERN, rule="none")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé中\U0001f600 \n", max_size=30))
def test_spans_are_those_of_the_characters_whose_bytes_a_token_holds(text):
    encoding, token_bytes = A.encoder(PATH, P.PATTERN)
    tokens = encoding.encode_ordinary(text)
    starts, ends = A.char_spans(text.encode(), token_bytes[np.array(tokens, np.int64)])
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for token, a, b in zip(tokens, starts, ends, strict=True):
        held = owner[at : at + len(encoding.decode_single_token_bytes(token))]
        at += len(held)
        assert (a, b) == (held[0], held[-1] + 1)


def test_vocabulary_may_be_found_by_the_task(spark, documents):
    docs = documents([(1, "one two\nthree")])
    plain = A.attribute(docs, PATH, P.PATTERN).collect()
    assert A.attribute(docs, lambda: PATH, P.PATTERN).collect() == plain
