"""Importance resampling toward a target distribution over hashed word runs, read off Arrow's UTF-8 buffers.

A byte automaton of one table runs over the text buffer of a whole batch: each byte becomes its lower-case form, or zero
where no word may hold it. Word boundaries are the differences of neighbouring bytes, cut at the ends of the texts.
The CRC-32 registers of all words advance together, byte by byte and longest words first, by the usual table; what a
word has beyond ``STEPS`` bytes is finished by itself. A run of n words goes on from the register of the run of n - 1.

The corpus and the target are counted in ``buckets`` counters, one set for each task. A bucket's gain is the logarithm of
its share of the target over that of the corpus, smoothed by one; a document's weight is the floored mean of its gains,
and Gumbel noise from a hash of its id turns drawing without replacement into taking the highest scores. Scores are
whole numbers within a few tens of thousands, so their counts give the score of the last document drawn, and only
those that reach it are dealt by ranges of (score, id) and numbered.

Cases, all defined: a null or empty text has no words, weight 0 and its noise as score, and is not drawn if ``min_words``
is above 0. A null id is hashed as an empty one and is the least of a tie. Rows that share an id have the same noise;
of equal scores and ids the fewer features come first, and rows equal in all of these are numbered in any order.
Without a target text, or a document, every bucket counts as seen once. Empty tables give an empty result. Texts
are read whole, in parts of ``PART_BYTES`` that end between texts. Other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ALL_ONES = 0xFFFFFFFF
#: Bytes of a word that advance together with those of all others.
STEPS = 64
#: Bytes of text that are worked on at a time, unless one text is longer.
PART_BYTES = 4_000_000


@dataclass(frozen=True)
class Rules:
    """``max_run``: words of the longest feature; ``percent``: how many of the documents of ``min_words`` are drawn."""

    max_run: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    min_words: int = 20
    percent: int = 10


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _folding() -> np.ndarray:
    """For each byte its lower-case form if words may hold it, else zero: digits, letters and all bytes beyond ASCII."""
    folded = np.zeros(256, np.uint8)
    folded[0x80:] = np.arange(0x80, 0x100)
    for first, last in (b"09", b"az"):
        folded[first : last + 1] = np.arange(first, last + 1)
    folded[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return folded


CRC, FOLDED = _crc_table(), _folding()


def word_spans(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; text i is ``folded[offsets[i]:offsets[i + 1]]``."""
    inside = folded != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(folded)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def advance(registers: np.ndarray, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes from each start up to its end."""
    order = np.argsort(starts - ends, kind="stable")
    starts, ends, state = starts[order], ends[order], registers[order]
    shorter = starts - ends  # ascending
    longest = min(STEPS, -int(shorter[0])) if len(order) else 0
    for k in range(longest):
        n = np.searchsorted(shorter, -k)
        state[:n] = CRC[(state[:n] ^ folded[starts[:n] + k]) & 0xFF] ^ state[:n] >> 8
    for i in range(np.searchsorted(shorter, -STEPS)):
        rest = folded[starts[i] + STEPS : ends[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ ALL_ONES) ^ ALL_ONES
    out = np.empty_like(state)
    out[order] = state
    return out


def features(folded: np.ndarray, offsets: np.ndarray, max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and CRC-32 of every run of 1, then 2, up to ``max_run`` consecutive words of a text."""
    starts, ends, text = word_spans(folded, offsets)
    state = np.full(len(starts), ALL_ONES, np.uint32)
    for run in range(1, max_run + 1):
        if run > 1:
            state = CRC[(state[:-1] ^ ord(" ")) & 0xFF] ^ state[:-1] >> 8
        state = advance(state, folded, starts[run - 1 :], ends[run - 1 :])
        whole = text[run - 1 :] == text[: len(state)]
        yield text[: len(state)][whole], state[whole] ^ np.uint32(ALL_ONES)
        if len(state) < 2:
            return


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row of each part, its folded bytes, and where in them each text starts and the last one ends."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_BYTES, "right")) - 1)
        at = offsets[first : last + 1]
        yield first, last, FOLDED[raw[at[0] : at[-1]]], at - at[0]
        first = last


def _counter(rules: Rules):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for *_, folded, offsets in parts(batch.column(0)):
                for _, crc in features(folded, offsets, rules.max_run):
                    found += np.bincount(crc % rules.buckets, minlength=rules.buckets)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str, rules: Rules) -> np.ndarray:
    """How many features of all texts fall in each bucket: one row for each bucket and task is shuffled."""
    local = texts.select(text_col).mapInArrow(_counter(rules), "bucket long, n long")
    total = local.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # as many rows as there are buckets
    counts = np.zeros(rules.buckets, np.int64)
    counts[total["bucket"].to_numpy()] = total["n"].to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, floored."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratios = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weigher(shared, rules: Rules):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for first, last, folded, offsets in parts(batch.column(1)):
                n_texts = last - first
                words, n, total = (np.zeros(n_texts, np.int64) for _ in range(3))
                for run, (text, crc) in enumerate(features(folded, offsets, rules.max_run)):
                    each = np.bincount(text, minlength=n_texts)
                    words += each if run == 0 else 0
                    n += each
                    total += np.bincount(text, gain[crc % rules.buckets], n_texts).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(first, n_texts)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, target: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for every row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, rules), bucket_counts(target, target_col, rules))
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(_weigher(shared, rules), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), rules.seed))


def draw(scored: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for those drawn, by falling score and then id, null for all others."""
    scored = cut_lineage(scored)
    long_enough = F.col("n_words") >= rules.min_words
    by_score = scored.where(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("score", "descending")])
    reached = np.cumsum(by_score["n"].to_numpy())
    n_drawn = int(reached[-1]) * rules.percent // 100 if len(reached) else 0
    if not n_drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = by_score["score"][int(np.searchsorted(reached, n_drawn))].as_py()
    may = long_enough & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")]
    spread = scored.where(may).withColumn("_row", F.monotonically_increasing_id())  # tells equal rows apart
    dealt = spread.repartitionByRange(*order, F.asc("_row")).sortWithinPartitions(*order, F.asc("_row"))
    placed = cut_lineage(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, starts = 0, []
    for row in sizes:
        starts.append((row["part"], before))
        before += row["count"]
    first = scored.sparkSession.createDataFrame(starts, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.join(F.broadcast(first), part == F.col("_part")).withColumn("rank", F.when(place <= n_drawn, place))
    rest = scored.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``."""
    return draw(score(docs, target, rules, id_col, text_col), rules)
