"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

Test items are the indexed side, in slices of a bounded number of postings, each broadcast in turn; the
training texts stay where they are and are read once for each slice. Items of a slice are indexed by class of
length: up to ``CLASS_WORDS`` words, and each class after up to ``CLASS_GROWTH`` times as many. For each class a text
is cut into passages twice as long as the longest item that the class may hold, each half overlapping the next, so every
item that a text holds lies whole in a passage, and what is found of it depends on the item and the text alone, not on
the items beside it. A text is cut into words and these into codes once for all classes of a slice.
Scores are divided by the item's score for itself, so one threshold serves all items.

Items are ordered by length and stand in blocks. For each term the index holds its postings by item, its
largest weight, and one entry for each block in which it occurs: the largest weight there and the place of its
postings. All of it grows with the postings, nothing with terms times blocks. A passage of which no block can
reach the threshold, by the sum of its terms' entries, is left at once. The others are searched by WAND: a
cursor for each term, ordered by item; the pivot is the first item at which the largest weights of the cursors
up to it could reach the threshold; if the entries of the pivot's block cannot, all those cursors skip the block;
else they move to the pivot and it is scored. No bound is below a score, so every item above the threshold is
retrieved.

What is retrieved is verified by word shingles: the passage must hold a given part of the question's and a given
part of the answer's. The answer is the text's last sentence, or the column given; an item of a single
sentence has no answer of its own, and an item without a word in its question is verified by its answer.

Cases, all defined: null or empty texts and items hold nothing and match nothing. Items that share an id
but not the text are each indexed; a pair is returned once for each row of documents. Parts shorter
than a shingle are one shingle. Empty tables give an empty result. Texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import slices
from millrace.session import cut_lineage

#: Fixed values of BM25.
K1, B = 1.2, 0.75
SHINGLE_WORDS = 5
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
#: Words of the longest item of the first class, and how many times as many each class has as the one before.
CLASS_WORDS, CLASS_GROWTH = 32, 4
#: Block bounds that are summed at a time.
BOUNDS = 500_000
SLACK = 1e-9
MIX = np.uint64(0x9E3779B97F4A7C15)

PAIRS = "item_id long, score double, question_overlap double, answer_overlap double"
NO_RANGE = np.empty(0, np.int64)


@dataclass(frozen=True)
class Rules:
    """``score`` is the least part of an item's own score, ``question`` and ``answer`` the least parts of their shingles."""

    score: float = 0.6
    question: float = 0.8
    answer: float = 0.8
    block_items: int = 2
    slice_postings: int = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str, answer: str | None) -> tuple[list[str], list[str]]:
    if answer is not None:
        return words_of(text), words_of(answer)
    sentences = [s for s in SENTENCE_END.split(text) if WORD.search(s)]
    if len(sentences) < 2:
        return words_of(text), []
    return [w for s in sentences[:-1] for w in words_of(s)], words_of(sentences[-1])


def class_of(n_words: int) -> int:
    """The words of the longest item in the class of items of ``n_words``."""
    longest = CLASS_WORDS
    while longest < n_words:
        longest *= CLASS_GROWTH
    return longest


def shingles(coded: np.ndarray, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``n`` terms; a run with an unknown term, -1, is left out."""
    if len(coded) < n or not n:
        return np.empty(0, np.uint64)
    count = len(coded) - n + 1
    mixed, known = np.full(count, n, np.uint64), np.ones(count, bool)
    for i in range(n):
        part = coded[i : i + count]
        known &= part >= 0
        mixed = (mixed ^ (part + 1).astype(np.uint64)) * MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed[known])


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end."""
    counts = ends - starts
    if not counts.sum():
        return NO_RANGE
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


@dataclass(frozen=True)
class Part:
    """An item's question or answer: the length of its shingles in words, and their hashes."""

    words: int
    hashes: np.ndarray

    @classmethod
    def of(cls, coded: np.ndarray) -> Part:
        n = min(SHINGLE_WORDS, len(coded))
        return cls(n, shingles(coded, n))

    def held(self, passage: np.ndarray, seen: dict[int, np.ndarray]) -> float:
        """How much of it the passage holds; all if there is nothing to hold."""
        if not self.words:
            return 1.0
        if self.words not in seen:
            seen[self.words] = shingles(passage, self.words)
        return float(np.isin(self.hashes, seen[self.words]).mean())


@dataclass(frozen=True)
class Index:
    """The items of one class in a slice. Term t's entries, one for each block, are those from ``entries[t]`` to ``entries[t + 1]``,
    and entry e's postings those from ``first[e]`` to ``first[e + 1]``."""

    terms: dict[str, int]
    largest: np.ndarray
    entries: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    ids: list[int]
    parts: list[tuple[Part, Part]]
    window: int
    block_items: int

    def open_passages(self, coded: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """The passages of which some block may reach the threshold, with their distinct known terms."""
        n_blocks = -(-len(self.ids) // self.block_items)
        passages = max(1, BOUNDS // n_blocks)
        for some in range(0, len(starts), passages):
            at = slice(some, some + passages)
            n = len(starts[at])
            codes = coded[ranges(starts[at], ends[at])]
            key = np.unique((np.repeat(np.arange(n), ends[at] - starts[at]) * len(self.largest) + codes)[codes >= 0])
            passage, term = key // len(self.largest), key % len(self.largest)
            low, high = self.entries[term], self.entries[term + 1]
            entry = ranges(low, high)
            cell = np.repeat(passage, high - low) * n_blocks + self.block[entry]
            bounds = np.bincount(cell, self.block_max[entry], n * n_blocks).reshape(n, n_blocks)
            for i in np.flatnonzero(bounds.max(axis=1) >= threshold - SLACK):
                yield some + int(i), term[passage == i]

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items of a passage's distinct known terms whose score is at least ``threshold``, by block-max WAND."""
        items, weights, block, block_max, first = (memoryview(a) for a in (self.items, self.weights, self.block, self.block_max, self.first))
        size, least = self.block_items, threshold - SLACK
        # A cursor: item, posting, entry, end of entries, largest weight.
        cursors = []
        for t in terms.tolist():
            e = int(self.entries[t])
            cursors.append([items[first[e]], first[e], e, int(self.entries[t + 1]), float(self.largest[t])])

        def move(cursor: list, item: int) -> bool:
            """To the first posting at or after ``item``; False if there is none."""
            cursor[2] = bisect_left(block, item // size, cursor[2], cursor[3])
            if cursor[2] < cursor[3]:
                cursor[1] = bisect_left(items, item, first[cursor[2]], first[cursor[2] + 1])
                if cursor[1] == first[cursor[2] + 1]:
                    cursor[2] += 1
            if cursor[2] >= cursor[3]:
                return False
            cursor[0] = items[cursor[1]]
            return True

        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                bound += cursor[4]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound = 0.0
            for cursor in cursors[: pivot + 1]:
                e = bisect_left(block, item // size, cursor[2], cursor[3])
                if e < cursor[3] and block[e] == item // size:
                    bound += block_max[e]
            if bound < least:
                target = (item // size + 1) * size
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(weights[c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                target, moved = item + 1, cursors[: pivot + 1]
            else:
                target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            ended = [id(c) for c in moved if not move(c, target)]
            if ended:
                cursors = [c for c in cursors if id(c) not in ended]

    def search(self, coded: np.ndarray, rules: Rules, best: dict[int, tuple[float, float, float]]) -> None:
        """Put the items that a text holds in ``best``, with the overlaps and the score of their best passage."""
        step = self.window // 2
        starts = np.arange(0, max(1, len(coded) - step), step)
        ends = np.minimum(starts + self.window, len(coded))
        for i, inside in self.open_passages(coded, starts, ends, rules.score):
            passage, seen = coded[starts[i] : ends[i]], {}
            for item, score in self.retrieve(inside, rules.score):
                asked, told = (part.held(passage, seen) for part in self.parts[item])
                row = (asked, told, score)
                if asked >= rules.question - SLACK and told >= rules.answer - SLACK:
                    best[self.ids[item]] = max(row, best.get(self.ids[item], row))


@dataclass(frozen=True)
class Slice:
    """The indexes of a slice's classes, with one code for each term and, for each index, its own codes by these."""

    terms: dict[str, int]
    indexes: list[Index]
    codes: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, indexes: list[Index]) -> Slice:
        terms: dict[str, int] = {}
        codes = []
        for index in indexes:
            code = np.array([terms.setdefault(w, len(terms)) for w in index.terms], np.int64)
            order = np.argsort(code)
            codes.append((code[order], order))  # an index's own codes are the places of its terms
        return cls(terms, [replace(index, terms={}) for index in indexes], codes)

    def pairs(self, text: str | None, rules: Rules) -> Iterator[tuple[int, float, float, float]]:
        words = words_of(text)
        coded = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        for index, (known, own) in zip(self.indexes, self.codes, strict=True):
            at = np.minimum(np.searchsorted(known, coded), len(known) - 1)
            index.search(np.where(known[at] == coded, own[at], -1), rules, best)
        for item_id, (asked, told, score) in best.items():
            yield item_id, score, asked, told


def build(rows: list[tuple[int, list[str], list[str]]], spread: dict[str, int], item_count: int, mean_words: float, rules: Rules) -> Index:
    """The index of items (id, question, answer) of one class; ``spread`` says in how many of all ``item_count`` items each term occurs."""
    rows = sorted(rows, key=lambda r: (len({*r[1], *r[2]}), r))
    terms: dict[str, int] = {}
    parts, kept = [], []
    for question, answer in (r[1:] for r in rows):
        coded = [np.array([terms.setdefault(w, len(terms)) for w in part], np.int64) for part in (question, answer)]
        parts.append((Part.of(coded[0]), Part.of(coded[1])))
        found, tf = np.unique(np.concatenate(coded), return_counts=True)
        kept.append((found, tf))
    df = np.array([spread[w] for w in terms], float)
    idf = np.log(1 + (item_count - df + 0.5) / (df + 0.5))
    weights = []
    for found, tf in kept:
        raw = idf[found] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean_words))
        weights.append(raw / raw.sum())
    term = np.concatenate([found for found, _ in kept])
    item = np.repeat(np.arange(len(kept)), [len(found) for found, _ in kept])
    weight = np.concatenate(weights)
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    block = item // rules.block_items
    starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
    entry_max = np.maximum.reduceat(weight, starts)
    entries = np.searchsorted(term[starts], np.arange(len(terms) + 1))
    return Index(
        terms, np.maximum.reduceat(entry_max, entries[:-1]), entries, block[starts], entry_max, np.concatenate([starts, [len(item)]]),
        item, weight, [r[0] for r in rows], parts, 2 * class_of(len(rows[0][1]) + len(rows[0][2])), rules.block_items,
    )


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts, answers in slices(batches):
        found = []
        for key, text, answer in zip(keys, texts, answers, strict=True):
            counts: dict[str, int] = {}
            for w in (w for part in question_and_answer(text, answer) for w in part):
                counts[w] = counts.get(w, 0) + 1
            found.extend((key, term, tf) for term, tf in counts.items())
        columns = zip(*found, strict=True) if found else [[]] * 3
        arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["item_key", "term", "tf"])


def sliced(items: DataFrame, rules: Rules = Rules(), answer_col: str | None = None) -> Iterator[list[Index]]:
    """The slices of the index, built one at a time, class by class; each holds about ``slice_postings`` postings."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    texts = items.select(F.col("item_id").cast("long"), "text", answer.alias("answer"))
    texts = texts.where(F.coalesce("text", "answer").isNotNull()).withColumn("text", F.coalesce("text", F.lit(""))).distinct()
    texts = cut_lineage(texts.withColumn("item_key", F.xxhash64("item_id", "text", "answer")))
    terms = cut_lineage(texts.select("item_key", "text", "answer").mapInArrow(_item_terms, "item_key long, term string, tf long"))
    total = terms.agg(F.count_distinct("item_key").alias("items"), F.sum("tf").alias("words"), F.count(F.lit(1)).alias("postings")).first()
    if not total["items"]:
        return
    spread = cut_lineage(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n_slices = -(-total["postings"] // rules.slice_postings)
    for k in range(n_slices):
        here = F.pmod("item_key", F.lit(n_slices)) == k
        worded = terms.where(here)
        found = texts.where(here).join(worded.select("item_key").distinct(), "item_key", "left_semi")
        rows = found.select("item_id", "text", "answer").toArrow().to_pylist()
        if rows:
            df = spread.join(worded.select("term").distinct(), "term", "left_semi").toArrow()
            counts = dict(zip(df["term"].to_pylist(), df["df"].to_pylist(), strict=True))
            classes: dict[int, list] = {}
            for r in rows:
                question, answer = question_and_answer(r["text"], r["answer"])
                classes.setdefault(class_of(len(question) + len(answer)), []).append((r["item_id"], question, answer))
            yield [build(classes[c], counts, total["items"], total["words"] / total["items"], rules) for c in sorted(classes)]


def indexes(items: DataFrame, rules: Rules = Rules(), answer_col: str | None = None) -> Iterator[Index]:
    """All indexes of all slices."""
    return (index for some in sliced(items, rules, answer_col) for index in some)


def _searcher(shared, rules: Rules, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for columns in slices(batches):
            *kept, texts = columns
            out = [(*row, *pair) for *row, text in zip(*kept, texts, strict=True) for pair in found.pairs(text, rules)]
            kinds = (*[pa.int64()] * (len(kept) + 1), pa.float64(), pa.float64(), pa.float64())
            made = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, kinds, strict=True)], names=names)

    return search


def leaks(
    docs: DataFrame, items: DataFrame, rules: Rules = Rules(), answer_col: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: the items that each document holds.

    ``carry`` names further columns of whole numbers that the result keeps, before ``item_id``.
    """
    kept = [F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("long") for c in carry)]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in carry), PAIRS])
    names = [part.split()[0] for part in schema.split(", ")]
    found = docs.sparkSession.createDataFrame([], schema)
    for indexes_of_slice in sliced(items, rules, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(Slice.of(indexes_of_slice))
        found = found.union(rows.mapInArrow(_searcher(shared, rules, names), schema))
    return found
