import random

import numpy as np
import pytest

from millrace.llm import decontamination as D

ITEMS = [
    (1, "What is the capital of the green island north of here? It is the town of Aberwhistle."),
    (2, "A train leaves at nine and travels for two hours at sixty miles an hour, how far does it go?\nOne hundred and twenty miles."),
    (3, ""), (4, None), (5, "Short one."), (2, "Another text that goes by the same id as the second item does here."),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS df", "3 AS terms")


def noise(rng, n):
    return " ".join(rng.choice(["train", "town", "the", "of", "hours", "miles", "green", "is", "at", *(f"w{i}" for i in range(400))]) for _ in range(n))


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, rows, rules=D.Rules()):
    """Every document against every item: the part of the question's and of the answer's shingles that the whole text holds."""
    out = set()
    for item, text, *answer in rows:
        q, a = (shingles(p) for p in D.question_and_answer(text or "", answer[0] if answer else None))
        for doc, body in docs:
            words = D.words_of(body)
            have = {tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1)}
            asked, told = (len(p & have) >= least * len(p) for p, least in ((q, rules.question), (a, rules.answer)))
            if q | a and asked and told:
                out.add((doc, item))
    return out


def test_finds_what_brute_force_finds(spark, documents):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        text = noise(rng, rng.choice([0, 5, 200, 900]))
        for _, item in rng.sample(ITEMS[:2] + ITEMS[4:], rng.randint(0, 3)):
            cut = rng.randint(0, len(text))
            text = f"{text[:cut]} {item.upper() if rng.random() < 0.5 else item} {text[cut:]}"
        rows.append((i, text))
    rows += [(100, ITEMS[0][1][:40]), (101, "What is the capital of the green island north of here?")]
    got = {(r.doc_id, r.item_id) for r in D.leaks(documents(rows), items(spark)).collect()}
    assert got == brute(rows, ITEMS)
    assert len(got) > 40 and {p[1] for p in got} == {1, 2, 5} and all(p[0] < 100 for p in got)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_wand_loses_no_item_and_scores_as_all_postings_do(spark, block):
    rng = random.Random(block)
    rows = [(i, noise(rng, rng.choice([4, 12, 30]))) for i in range(60)]
    rules = D.Rules(block_items=block)
    (index,) = D.indexes(items(spark, rows), rules)
    for least in (0.1, 0.3, 0.6):
        for _ in range(40):
            words = D.words_of(noise(rng, 60) if rng.random() < 0.7 else rng.choice(rows)[1] + noise(rng, 20))
            coded = np.array([index.terms.get(w, -1) for w in words])
            known = np.unique(coded[coded >= 0])
            scores = {}
            for t in known:
                for p in range(index.first[index.entries[t]], index.first[index.entries[t + 1]]):
                    item = int(index.items[p])
                    scores[item] = scores.get(item, 0.0) + index.weights[p]
            want = {i: s for i, s in scores.items() if s >= least - 1e-9}
            assert dict(index.retrieve(known, least)) == pytest.approx(want)
            opened = list(index.open_passages(coded, np.array([0]), np.array([len(coded)]), least))
            assert opened or not want
            assert all(sorted(terms) == sorted(known) for _, terms in opened)


def test_index_grows_with_postings_alone(spark):
    """No array has more cells than there are postings, whatever the number of terms and blocks."""
    rows = [(i, " ".join(f"t{i * 7 % 501}x{j}" for j in range(5))) for i in range(800)]
    (index,) = D.indexes(items(spark, rows))
    assert max(a.size for a in vars(index).values() if hasattr(a, "size")) <= len(index.items) + 1


def test_answers_and_questions_are_verified_apart(spark, documents):
    rows = [(1, "Who wrote down the long song of the nine rivers and seven hills", "Marta of the lower valley"), (2, "...", "only an answer stands in this one"), (3, "?", "")]
    table = spark.createDataFrame(rows, "item_id long, text string, answer string")
    texts = [(1, f"{rows[0][1]} {rows[0][2]}"), (2, rows[0][1]), (3, rows[0][2]), (4, rows[1][2]), (5, None)]
    got = {(r.doc_id, r.item_id) for r in D.leaks(documents(texts), table, answer_col="answer").collect()}
    assert got == {(1, 1), (4, 2)} == brute(texts[:4], rows)


def test_slices_give_the_same_pairs(spark, documents):
    docs = documents([(i, f"{noise(random.Random(i), 50)} {ITEMS[i % 2][1]}") for i in range(8)])
    one = D.leaks(docs, items(spark)).collect()
    many = D.leaks(docs, items(spark), D.Rules(slice_postings=8)).collect()
    assert sorted((r.doc_id, r.item_id) for r in one) == sorted((r.doc_id, r.item_id) for r in many)


def test_answer_column(spark, documents):
    rows = spark.createDataFrame([(9, "Which of the seven rivers runs north all year", "the Lower Ember of course")], "item_id long, text string, answer string")
    docs = documents([(1, "x Which of the seven rivers runs north all year? The lower Ember, of course."), (2, "the lower ember of course is a river")])
    (r,) = D.leaks(docs, rows, answer_col="answer").collect()
    assert (r.doc_id, r.question_overlap, r.answer_overlap) == (1, 1.0, 1.0)


def test_odd_rows_and_empty_tables(spark, odd_documents, documents):
    assert D.leaks(odd_documents, items(spark)).count() == 0
    assert D.leaks(documents([]), items(spark)).count() == 0
    assert D.leaks(documents([(1, ITEMS[0][1])]), items(spark, [])).count() == 0
    assert [r.item_id for r in D.leaks(documents([(1, ITEMS[0][1])] * 2), items(spark)).collect()] == [1, 1]


@pytest.mark.parametrize("slice_postings", [20, 100, 1_000_000])
def test_what_is_found_does_not_depend_on_slices_or_companions(spark, documents, slice_postings):
    rng = random.Random(12)
    question, answer = "Which seven rivers of the plain run north all year?", "The lower Ember does."
    long = (2, " ".join(f"long{rng.randrange(10**6)}" for _ in range(1800)) + ".")
    apart = f"{question} {' '.join(f'gap{i}' for i in range(300))} {answer}"
    near = f"{question} {' '.join(f'gap{i}' for i in range(15))} {answer}"
    docs = documents([(1, apart), (2, near), (3, f"before {long[1]} after"), (4, f"{long[1]} {near}")])
    rows = [(1, f"{question} {answer}"), *[(10 + i, noise(rng, rng.choice([4, 40, 200]))) for i in range(12)]]
    rules = D.Rules(slice_postings=slice_postings)
    with_long = {(r.doc_id, r.item_id) for r in D.leaks(docs, items(spark, [*rows, long]), rules).collect()}
    without = {(r.doc_id, r.item_id) for r in D.leaks(docs, items(spark, rows), rules).collect()}
    assert with_long == {(2, 1), (4, 1), (3, 2), (4, 2)} and without == {(2, 1), (4, 1)}
