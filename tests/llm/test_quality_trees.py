import random

import numpy as np
import pytest

from millrace.llm import quality_trees as Q


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = Q.boost(x, y, rounds=20, depth=3)

    def walk(row):
        total = trees.base
        for features, thresholds, values in zip(trees.features, trees.thresholds, trees.values, strict=True):
            node = 0
            while node < len(features):
                node = 2 * node + 1 + (row[features[node]] > thresholds[node])
            total += values[node - len(features)]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x) == pytest.approx([walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


def text(rng, good):
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"]
    body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
    return " ".join(body) + "." if good else " ".join(w.upper() + "!!" for w in body)


def test_held_out_accuracy_and_bound(spark, documents):
    rng = random.Random(2)
    rows = [(i, text(rng, i % 4 > 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    docs = documents(rows)
    for bound in (200, 40):
        got = {r.doc_id: r for r in Q.predict(docs, Q.fit(docs, labels, max_labelled=bound)).collect()}
        assert np.mean([got[i].predicted == int(i % 4 > 0) for i in range(200, 300)]) >= 0.97
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_odd_rows_and_empty_tables(spark, odd_documents, documents):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (1, None), (99, 1), (4, 0), (2, 0)], "doc_id long, quality int")
    trees = Q.fit(odd_documents, labels.selectExpr("*", "1 AS x", "2 AS label"))
    rows = Q.predict(odd_documents, trees).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    none = Q.fit(documents([]), labels)
    assert {r.score for r in Q.predict(odd_documents, none).collect()} == {0.5}
    assert Q.predict(documents([]), trees).count() == 0
    one = Q.boost(np.zeros((50, 2)), np.ones(50))
    assert one.score(np.zeros((1, 2)))[0] > 0.9


def test_statistics_of_plain_texts():
    at = dict(zip(Q.FEATURES, Q.statistics("One ONE two!\nOne ONE two!\n\n| 12"), strict=True))
    assert at["duplicate_lines"] == pytest.approx(1 / 3) and at["exclamation"] == 2 / 8 and at["pipe"] == 1 / 8
    assert at["all_upper_words"] == 2 / 8 and at["distinct_words"] == 5 / 8 and at["top_word"] == 2 / 8
    assert not Q.statistics(None).any() and not Q.statistics(" \n").any()


def naive_boost(x, y, rounds, depth, bins, rate, ridge, least_weight):
    """Trees by trying every cut of every feature at every node on the rows themselves."""
    edges = [sorted({sorted(c)[int(np.floor(q * (len(c) - 1)))] for q in np.linspace(0, 1, bins + 1)[1:-1]}) for c in x.T]
    share = (sum(y) + 1) / (len(y) + 2)
    margin, trees = [np.log(share / (1 - share))] * len(y), []
    for _ in range(rounds):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        nodes, cuts = [list(range(len(y)))], []
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-9, 0, np.inf)
                for f in range(x.shape[1]):
                    for cut in edges[f]:
                        sides = [[i for i in rows if (x[i, f] > cut) == side] for side in (False, True)]
                        g = [sum(y[i] - p[i] for i in side) for side in sides]
                        h = [sum(p[i] * (1 - p[i]) for i in side) for side in sides]
                        gain = sum(a * a / (b + ridge) for a, b in zip(g, h, strict=True)) - sum(g) ** 2 / (sum(h) + ridge)
                        if min(h) >= least_weight and gain > best[0] + 1e-9:
                            best = (gain, f, cut)
                cuts.append(best[1:])
                below += [[i for i in rows if not x[i, best[1]] > best[2]], [i for i in rows if x[i, best[1]] > best[2]]]
            nodes = below
        values = [rate * sum(y[i] - p[i] for i in rows) / (sum(p[i] * (1 - p[i]) for i in rows) + ridge) for rows in nodes]
        for rows, value in zip(nodes, values, strict=True):
            for i in rows:
                margin[i] += value
        trees.append((cuts, values))
    return trees, margin


def test_boosting_equals_trying_every_cut():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = ((x[:, 0] + x[:, 1] * (x[:, 2] > 0)) > 0.2).astype(float)
    rules = dict(rounds=3, depth=2, bins=8, rate=0.3, ridge=1.0, least_weight=0.5)
    fitted = Q.boost(x, y, **rules)
    trees, margin = naive_boost(x, y, **rules)
    for t, (cuts, values) in enumerate(trees):
        features, thresholds = zip(*cuts, strict=True)
        assert fitted.features[t].tolist() == list(features) and fitted.thresholds[t].tolist() == pytest.approx(thresholds)
        assert fitted.values[t].tolist() == pytest.approx(values)
    assert fitted.score(x) == pytest.approx([1 / (1 + np.exp(-m)) for m in margin])


def brute_statistics(t):
    raw, words = t.encode(), t.encode().split()
    n, lines = len(words), [line for line in t.encode().split(b"\n") if line.strip()]
    kinds = [Q.UPPER if c.isupper() else Q.LOWER if c.isalpha() else Q.DIGIT if c.isdigit() else Q.SPACE if c.isspace() else Q.SYMBOL if c.encode() in [bytes([s]) for s in Q.SYMBOLS] else Q.OTHER for c in t]
    bare = [w.strip(b"0123456789" + Q.SYMBOLS + b".,;:?-'\"()/") for w in words]
    size = [len(w) for w in words]
    mean = sum(size) / n
    return [
        np.log(1 + len(raw)), np.log(1 + n), len(raw) / len(t), *(kinds.count(k) / len(t) for k in range(6)),
        t.count("!") / n, t.count("|") / n, (t.count(".") + t.count("?")) / n, mean, (sum((s - mean) ** 2 for s in size) / n) ** 0.5, np.log(1 + max(size)),
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(words.count(w) for w in words) / n,
        sum(not b for b in bare) / n, sum(w[-1] in Q.SYMBOLS for w in words) / n, sum(len(b) > 1 and b.isupper() for b in bare) / n,
        np.log(1 + len(lines)), np.log(1 + sum(map(len, lines)) / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(line) < 30 for line in lines) / len(lines),
    ]


def test_statistics_equal_brute_force():
    rng = random.Random(3)
    parts = ["One", "ONE!", "two", "12", "a|b", "é?", "中", "x.", "$$", "\n", "\n\n", "long" * 9, "~"]
    for _ in range(200):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        if t.split():
            assert Q.statistics(t).tolist() == pytest.approx(brute_statistics(t))
