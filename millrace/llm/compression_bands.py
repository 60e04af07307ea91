"""Quality rules from compression: zstandard ratios over whole documents and over fixed chunks.

The ratio is compressed bytes over UTF-8 bytes. Text that repeats itself compresses too well, noise
hardly at all; both limits move with length, since a frame's fixed cost weighs on short text and long
text gives the compressor more to refer back to. Chunks find a document of which a large part is out of
band though its whole is not. Fixed bands bound what any text may reach; judge_learned() narrows them, length
by length, to what texts marked as good reach.

Cases, all defined: a null text has no words, empty lines count as none, and a text of no bytes has
ratio 1.0 and no chunk. Every row is judged on its own, so repeated rows get equal results and an
empty table an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import quantiles
from millrace.llm.batches import map_slices
from millrace.session import cut_lineage

#: Fixed values of the base rules.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, whole_ratio double, bad_chunk_share double"
)

MEASURED = SCHEMA + ", n_bytes long, chunk_sizes array<long>, chunk_ratios array<double>"
#: Learned limits leave out this part of good texts at either end, and stand so far below and above the rest; they are learned
#: for each half octave of bytes with so many good texts.
LEARNED_TAIL, LEARNED_BELOW, LEARNED_ABOVE, LEARNED_TEXTS = 0.001, 0.005, 0.01, 20


@dataclass(frozen=True)
class Bands:
    """Limits of the ratios.

    ``whole`` lists (bytes from, least, most) by rising length. A chunk is bad outside ``chunk``; a
    last piece of under half a chunk joins the one before. A document is rejected out of its whole
    band, or if bad chunks make up more than ``max_bad_share`` of its bytes.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.30, 1.05),
        (256, 0.30, 0.95),
        (512, 0.30, 0.90),
        (1024, 0.27, 0.80),
        (4096, 0.24, 0.70),
        (16384, 0.20, 0.65),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.20, 0.85)
    max_bad_share: float = 0.3
    level: int = 3

    def limits(self, n_bytes: int) -> tuple[float, float]:
        return next((least, most) for start, least, most in reversed(self.whole) if n_bytes >= start)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three consecutive words found twice or more in the text."""
    if len(words) <= WINDOW_WORDS:
        return 0
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pairs = coded[:-2] * len(ids) + coded[1:-1]
    if len(ids) > 2_000_000:  # three ids would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, of, counts = np.unique(pairs * len(ids) + coded[2:], return_inverse=True, return_counts=True)
    again = counts[of] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW_WORDS):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def chunk_ratios(raw: bytes, bands: Bands, compress: Callable[[bytes], bytes]) -> tuple[list[int], list[float]]:
    """Bytes and ratio of each chunk; none of a single chunk, for which the whole band speaks."""
    cuts = list(range(0, len(raw), bands.chunk_bytes))
    if len(cuts) > 1 and len(raw) - cuts[-1] < bands.chunk_bytes // 2:
        cuts.pop()
    if len(cuts) <= 1:
        return [], []
    ends = [*cuts[1:], len(raw)]
    sizes = [end - start for start, end in zip(cuts, ends, strict=True)]
    return sizes, [len(compress(raw[start:end])) / (end - start) for start, end in zip(cuts, ends, strict=True)]


def measure(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """judge() with ``n_bytes, chunk_sizes, chunk_ratios`` added."""

    def make() -> Callable[..., dict]:
        compress = zstandard.ZstdCompressor(level=bands.level).compress

        def one(text: str) -> tuple:
            raw = text.encode()
            words = raw.split()
            n = len(words)
            lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
            again = repeated_words(words)
            failed = n < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * n
            whole = len(compress(raw)) / len(raw) if raw else 1.0
            sizes, parts = chunk_ratios(raw, bands, compress)
            out = [size for size, ratio in zip(sizes, parts, strict=True) if not bands.chunk[0] <= ratio <= bands.chunk[1]]
            bad = sum(out) / len(raw) if raw else 0.0
            least, most = bands.limits(len(raw))
            kept = not failed and least <= whole <= most and bad <= bands.max_bad_share
            chars = len(text) - sum(map(text.count, ASCII_SPACE))
            return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, kept, whole, bad, len(raw), sizes, parts

        names = [part.split()[0] for part in MEASURED.split(", ")]

        def work(ids: list, texts: list) -> dict:
            return dict(zip(names, [ids, *zip(*(one(text or "") for text in texts), strict=True)], strict=True))

        return work

    return map_slices(docs.select(F.col(id_col).cast("long"), text_col), make, MEASURED)


def judge(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of base counts, ratios and verdicts for each row of ``docs``."""
    return measure(docs, bands, id_col, text_col).drop("n_bytes", "chunk_sizes", "chunk_ratios")


def _length_class(n_bytes: Column) -> Column:
    return F.floor(2 * F.log2(n_bytes)).cast("int")


#: Limits of one kind of piece: (least, most) by length class.
Limits = dict[int, tuple[float, float]]


def learned_limits(good: DataFrame) -> dict[bool, Limits]:
    """Limits of whole texts (False) and chunks (True) by length class, from measure() of good texts.

    Longer text compresses better. A class of too few texts therefore has the upper limit of the next shorter
    class that has enough, and the lower limit of the next longer; where there is none, no limit.
    """
    good = good.where(~F.col("base_failed"))
    whole = good.select(F.lit(False).alias("chunk"), _length_class(F.col("n_bytes")).alias("size"), F.col("whole_ratio").alias("ratio"))
    parts = good.select(F.explode(F.arrays_zip("chunk_sizes", "chunk_ratios")).alias("c"))
    chunks = parts.select(F.lit(True).alias("chunk"), _length_class(F.col("c.chunk_sizes")).alias("size"), F.col("c.chunk_ratios").alias("ratio"))
    counted = quantiles.ends(whole.union(chunks), ["chunk", "size"], "ratio", LEARNED_TAIL, 1 - LEARNED_TAIL)
    found = {(r["chunk"], r["size"]): (r["low"], r["high"]) for r in counted.where(F.col("n") >= LEARNED_TEXTS).collect()}
    limits: dict[bool, Limits] = {}
    for chunk in (False, True):
        sizes = sorted(size for of_chunk, size in found if of_chunk == chunk)
        limits[chunk] = {
            size: (
                min((found[chunk, s][0] - LEARNED_BELOW for s in sizes if s >= size), default=0.0),
                next((found[chunk, s][1] + LEARNED_ABOVE for s in reversed(sizes) if s <= size), float("inf")),
            )
            for size in range(64)
        }
    return limits


def judge_learned(docs: DataFrame, labels: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """judge() whose limits are also held to what texts of label quality 1 reach at each length."""
    measured = cut_lineage(measure(docs, bands))
    limits = learned_limits(measured.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"))

    def within(ratio: Column, chunk: bool, n_bytes: Column) -> Column:
        of_class = F.create_map(*(x for size, ends in limits[chunk].items() for x in (F.lit(size), F.array(*map(F.lit, ends)))))
        ends = F.try_element_at(of_class, _length_class(n_bytes))
        return F.coalesce(ratio.between(ends[0], ends[1]), F.lit(True))

    def bad_bytes(size: Column, ratio: Column) -> Column:
        good = ratio.between(*map(F.lit, bands.chunk)) & within(ratio, True, size)
        return F.when(good, F.lit(0).cast("long")).otherwise(size)

    bad = F.aggregate(F.zip_with("chunk_sizes", "chunk_ratios", bad_bytes), F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.when(F.col("n_bytes") > 0, bad / F.col("n_bytes")).otherwise(0.0)
    in_band = within(F.col("whole_ratio"), False, F.col("n_bytes")) & (share <= bands.max_bad_share)
    judged = measured.withColumns({"kept": F.col("kept") & in_band, "bad_chunk_share": share})
    return judged.drop("n_bytes", "chunk_sizes", "chunk_ratios")
