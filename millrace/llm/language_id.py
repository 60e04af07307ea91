"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams of one to three letters, with word edges, by
rank. A document's own most frequent n-grams are ranked alike, and its distance to a language is the
sum of how far each of them is out of place in the profile, absent ones counting the full profile
length. The nearest language wins.

N-grams are counted over every labelled document, within each task first, and only counts are shuffled.
A model is ``size`` ranks for each language, so it is small enough to collect and to send to every task.

Cases, all defined: a text that is null, empty or without a letter is ``und`` with score 0.0, and so is
every text where nothing was learned. A null language teaches nothing. Equal counts rank by n-gram,
equal distances go to the language first by code point. Repeated rows are predicted alike and count as
often as they occur. An empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_slices, slices

UNKNOWN = "und"
PROFILE_SIZE = 300
#: How sharply a smaller distance raises the score.
SHARPNESS = 20.0
#: Distinct n-grams that a task keeps for a language before it hands on their counts.
HELD_GRAMS = 1_000_000
ABSENT = 0x1FFFFF  # no code point


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of one to three letters as integers of three 21-bit parts; 0 stands for a word's edge."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    run = np.zeros(len(codes) + 2, np.int64)
    run[1:-1] = np.where(letter, codes, 0)
    used = np.ones(len(run), bool)
    used[1:] = (run[1:] != 0) | (run[:-1] != 0)
    run = run[used]
    one = run[run != 0] << 42 | ABSENT << 21 | ABSENT
    two = run[:-1] << 42 | run[1:] << 21 | ABSENT
    three = run[:-2] << 42 | run[1:-1] << 21 | run[2:]
    return np.concatenate([one, two, three[run[1:-1] != 0]])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return found, np.bincount(where, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def hand_on(lang: str) -> pa.RecordBatch:
        found, counts = held.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts)], names=["lang", "gram", "n"]
        )

    for texts, langs in slices(batches):
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(texts, langs, strict=True):
            by_lang.setdefault(lang, []).append(grams(text))
        for lang, parts in by_lang.items():
            new = np.unique(np.concatenate(parts), return_counts=True)
            held[lang] = _merge([held[lang], new]) if lang in held else new
            if len(held[lang][0]) > HELD_GRAMS:
                yield hand_on(lang)
    for lang in list(held):
        yield hand_on(lang)


@dataclass(frozen=True)
class Profiles:
    """``ranks[i, j]`` is the rank of n-gram ``grams[j]`` in language ``langs[i]``, or ``size`` if absent."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language as a part of the largest possible; None without a letter."""
        all_grams = grams(text) if text else np.empty(0, np.int64)
        if not len(all_grams) or not self.langs:
            return None
        found, counts = np.unique(all_grams, return_counts=True)
        order = np.argsort(-counts, kind="stable")[: self.size]
        top, place = found[order], np.arange(len(order))
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        out = np.abs(self.ranks[:, at[known]] - place[known]).sum(axis=1) + self.size * int((~known).sum())
        absent = self.ranks[:, at[known]] == self.size
        out += (absent * (self.size - np.abs(self.size - place[known]))).sum(axis=1)
        return out / (self.size * len(order))


def fit(docs: DataFrame, size: int = PROFILE_SIZE, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all languages in ``docs``; what is collected is ``size`` rows for each language."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counts = labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # In this form the limit is known before the sort: a task hands on ``size`` rows of a language at most.
    top = counts.withColumn("nth", rank).where(F.col("nth") <= size)
    rows = top.select("lang", "gram", (F.col("nth") - 1).alias("place")).collect()
    langs = sorted({r.lang for r in rows})
    known = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(langs), len(known)), size, np.int64)
    row_of = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        ranks[row_of[r.lang], np.searchsorted(known, r.gram)] = r.place
    return Profiles(langs, known, ranks, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: str = "") -> DataFrame:
    """``doc_id, lang_pred, score, distance``: the nearest language, how clearly it wins, and its distance from 0 to 1.

    ``carry`` names, with their types, further columns of ``docs`` that the result keeps.
    """
    carried = [part.split()[0] for part in carry.split(", ") if part]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make() -> Callable[..., dict]:
        model = shared.value

        def one(text: str | None) -> tuple[str, float, float]:
            far = model.distances(text)
            if far is None:
                return UNKNOWN, 0.0, 1.0
            nearest = int(np.argmin(far))
            score = 1.0 / np.exp(-SHARPNESS * (far - far[nearest])).sum()
            return model.langs[nearest], float(score), float(far[nearest])

        def work(ids: list, texts: list, *others: list) -> dict:
            langs, scores, far = zip(*map(one, texts), strict=True)
            return {"doc_id": ids, "lang_pred": langs, "score": scores, "distance": far, **dict(zip(carried, others, strict=True))}

        return work

    rows = docs.select(F.col(id_col).cast("long"), text_col, *carried)
    schema = "doc_id long, lang_pred string, score double, distance double"
    return map_slices(rows, make, ", ".join([schema, carry] if carry else [schema]))
