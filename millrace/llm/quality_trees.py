"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed inside tasks; labels, language, source and id are none of
them. Trees are fitted on a sample of labelled rows whose bound is a parameter, and flattened into
arrays by level, which one numpy expression per level traverses for a whole batch of documents.

Cases, all defined: a null text is the empty text, whose statistics are all zero. Labelled rows
without a document, with a null label, or from held-out documents teach nothing; a document with
several labels teaches each, and of several
rows with one id the one of least statistics teaches. Without labelled rows every score is 0.5, and with one class alone the
score is near that class. Repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_slices

#: The most labelled rows to fit on, taken in the order of a seeded hash of the id.
MAX_LABELLED = 20_000
SEED = 4

FEATURES = (
    "log_bytes", "log_words", "bytes_per_char", "upper", "lower", "digit", "space", "symbol", "other",
    "exclamation", "pipe", "sentence_end", "mean_word", "sd_word", "longest_word", "distinct_words",
    "adjacent_repeats", "top_word", "no_letter_words", "symbol_end_words", "all_upper_words",
    "log_lines", "mean_line", "duplicate_lines", "short_lines",
)
UPPER, LOWER, DIGIT, SPACE, SYMBOL, OTHER = range(6)
SYMBOLS = b"#*$%&|<>!~^=+_@{}[]\\"


@cache
def _classes() -> np.ndarray:
    def kind(c: str) -> int:
        if c.isupper():
            return UPPER
        if c.isalpha():
            return LOWER
        if c.isdigit():
            return DIGIT
        if c.isspace():
            return SPACE
        return SYMBOL if c.encode("utf-8", "replace") in {bytes([s]) for s in SYMBOLS} else OTHER

    return np.fromiter(map(kind, map(chr, range(0x110000))), np.uint8, 0x110000)


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shares = np.bincount(_classes()[codes], minlength=6) / len(codes)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    distinct = np.array(list(counts.values()))
    letters = [w.strip(b"0123456789" + SYMBOLS + b".,;:?-'\"()/") for w in counts]
    out[:] = (
        np.log1p(len(raw)), np.log1p(n), len(raw) / len(codes), *shares,
        raw.count(b"!") / n, raw.count(b"|") / n, (raw.count(b".") + raw.count(b"?")) / n,
        lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, distinct.max() / n,
        distinct[[not x for x in letters]].sum() / n,
        distinct[[w[-1] in SYMBOLS for w in counts]].sum() / n,
        distinct[[len(x) > 1 and x.isupper() for x in letters]].sum() / n,
        np.log1p(len(lines)), np.log1p(line_lengths.mean()),
        1 - len(set(lines)) / len(lines), (line_lengths < 30).mean(),
    )
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of ``depth`` levels: node j of a level has children 2j and 2j + 1 on the next.

    ``features`` and ``thresholds`` hold the inner nodes by tree and level order, ``values`` the leaves.
    A node that needs no split has an infinite threshold, so its rows all go left.
    """

    depth: int
    base: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, thresholds, values in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, features[at]] > thresholds[at])
            margin += values[node]
        return 1.0 / (1.0 + np.exp(-margin))


def _bin(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1), edges


def boost(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
    ridge: float = 1.0, least_weight: float = 1.0,
) -> Trees:
    """Fit trees to the logistic loss by Newton steps over binned features."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    features = np.zeros((rounds, inner), np.int64)
    thresholds = np.full((rounds, inner), np.inf)
    values = np.zeros((rounds, leaves))
    if not len(y):
        return Trees(depth, 0.0, features[:0], thresholds[:0], values[:0])
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    binned, edges = _bin(x, bins)
    margin = np.full(len(y), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            best = np.zeros(1 << level)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                cell = node * bins + binned[:, f]
                g = np.bincount(cell, gradient, bins << level).reshape(-1, bins)
                h = np.bincount(cell, hessian, bins << level).reshape(-1, bins)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least_weight) | (ht - hl < least_weight)] = 0
                gain = gain[:, : len(edges[f])]
                cut = gain.argmax(1)
                better = np.flatnonzero(gain.max(1) > best + 1e-9)
                at = (1 << level) - 1 + better
                best[better] = gain[better, cut[better]]
                features[t, at], thresholds[t, at] = f, edges[f][cut[better]]
            at = (1 << level) - 1 + node
            node = 2 * node + (x[np.arange(len(y)), features[t, at]] > thresholds[t, at])
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, hessian, leaves)
        values[t] = rate * g / (h + ridge)
        margin += values[t][node]
    return Trees(depth, base, features, thresholds, values)


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Trees:
    """Trees from at most ``max_labelled`` rows of ``labels`` and the documents they name.

    The sampled labels, a bounded number of pairs of integers, are broadcast to the documents, so no text is shuffled;
    the statistics of the sampled documents are what comes back to the driver.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    sample = named.orderBy(F.xxhash64(F.lit(SEED), "id"), "id", "label").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("id", "label", "text")

    def make() -> Callable[..., dict]:
        return lambda ids, y, texts: {"id": ids, "label": y, "x": [statistics(t) for t in texts]}

    made = map_slices(rows, make, "id long, label int, x array<double>")
    found = made.groupBy("id", "label").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (r.label, r.x))  # the same trees, whatever the order of tasks
    y = np.array([r.label for r in found], float)
    return boost(np.array([r.x for r in found], float).reshape(len(found), len(FEATURES)), y)


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make() -> Callable[..., dict]:
        model = shared.value

        def work(ids: list, texts: list) -> dict:
            scores = model.score(np.stack([statistics(t) for t in texts]))
            return {"doc_id": ids, "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return work

    rows = docs.select(F.col(id_col).cast("long"), text_col)
    return map_slices(rows, make, "doc_id long, score double, predicted int")
