"""Near copies by word shingles: Golay keys of several SimHashes gather texts into clouds, in which the texts decide.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. At 0.8
two SimHashes of 64 bits differ in about ten bits, far beyond what one set of Golay keys reaches. A text
therefore has ``TABLES`` independent SimHashes of 24 bits, each met by the Golay codewords near it; beside
the codeword stands, where op3 has an equal block, the least of the shingles' hashes under a hash function
of the table's own, which two texts share with a probability equal to their similarity. Fingerprints of
64 bits that meet under a key and differ in at most ``CANDIDATE_BITS`` are joined; a key hands on no more of
them than connect all that are. What is so connected is a cloud, and every text of a cloud is compared with
every other, shingle by shingle; texts that share a fingerprint are of one cloud.

No pair of a cloud becomes a row. Its texts come to a task once, if they hold ``CELL_SHINGLES`` shingles or fewer, and
are indexed by shingle: a text's similarities to all others are one count over its shingles' entries. A larger cloud is
cut into parts of that size; a part is indexed in a task of its own, and the texts of the parts before it stream by.
Texts are searched outward from those already linked and leave the index when reached, so thousands of copies of each other
cost little more than their number, and a task hands on no more links than connect what links connect.

Cases, all defined: texts of equal words but for the case of A-Z and white space are one node, and so are
all texts without a word. A text of five words or fewer is a single shingle. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_slices, slices
from millrace.llm.components import components
from millrace.llm.golay import near_codewords
from millrace.llm.simhash import SEED, TILE, links_of_keys, spanning_links
from millrace.session import cut_lineage

SHINGLE_WORDS = 5
MIN_JACCARD = 0.8
TABLES = 16
#: At a similarity of 0.8 two fingerprints differ in 10 bits on average, with a deviation of 3.
CANDIDATE_BITS = 18
#: Shingles of a cloud's part that a task indexes, 16 bytes each.
CELL_SHINGLES = 2_000_000
#: Nodes are broadcast up to so many, about 16 MB.
BROADCAST_NODES = 500_000
#: Shingles whose bits are counted at a time.
CHUNK = 4096

_ODD = np.random.default_rng(SEED).integers(1, 2**63, (2, 64), np.uint64) | np.uint64(1)


def words_of(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def shingle_hashes(joined: bytes) -> np.ndarray:
    """The distinct hashes of the shingles of words joined by single spaces."""
    words = joined.split()
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, last = xxhash.xxh64_intdigest, SHINGLE_WORDS - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:-last].tolist(), ends[last:].tolist(), strict=True)], np.uint64))


def _mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    x = hashes * _ODD[0, i]
    x ^= x >> np.uint64(32)
    x *= _ODD[1, i]
    return x ^ x >> np.uint64(29)


def _simhash(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)
    return 2 * ones > len(hashes)


def sketch(joined: bytes) -> tuple[int, list[int], list[int]]:
    """The fingerprint, the 24 bits of each table, and each table's least shingle."""
    hashes = shingle_hashes(joined)
    bits = np.concatenate([_simhash(_mixed(hashes, i)) for i in range(1 + 24 * TABLES // 64)])
    weights = 1 << np.arange(23, -1, -1)
    least = [int(_mixed(hashes, 16 + t).min() >> np.uint64(12)) for t in range(TABLES)]
    fp = int.from_bytes(np.packbits(bits[:64]).tobytes(), "big")
    return fp, (bits[64:].reshape(TABLES, 24) @ weights).tolist(), least


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, node, fp, segments, least, size`` for rows of ``doc_id, text_hash, text``; ``size`` counts words."""

    def make() -> Callable[..., dict]:
        def work(ids: list, hashes: list, texts: list) -> dict:
            joined = [words_of(t) for t in texts]
            fps, segments, least = zip(*map(sketch, joined), strict=True)
            nodes = np.array([xxhash.xxh64_intdigest(j, SEED + 1) for j in joined], np.uint64)
            return {
                "doc_id": ids, "text_hash": hashes, "node": nodes.view(np.int64), "fp": np.array(fps, np.uint64).view(np.int64),
                "segments": segments, "least": least, "size": [j.count(b" ") + 1 for j in joined],
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long"), "text_hash", "text")
    return map_slices(rows, make, "doc_id long, text_hash long, node long, fp long, segments array<long>, least array<long>, size long")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            fps = part.column(0).to_numpy(zero_copy_only=False)
            segments = np.array(part.column(1).flatten()).reshape(-1, TABLES)
            least = np.array(part.column(2).flatten()).reshape(-1, TABLES)
            for table in range(TABLES):
                row, name = near_codewords(segments[:, table])
                # The least shingle and the codeword, mixed into one number; a chance meeting costs a comparison alone.
                key = _mixed((least[row, table] << 12 | name).view(np.uint64), 40 + table % 8) + np.uint64(table)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[row])], names=["key", "fp"])


class Indexed:
    """Shingle sets by shingle: what each of them shares with a set is one count."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        self._index(np.arange(len(sets)))

    def _index(self, rows: np.ndarray) -> None:
        shingles = np.concatenate([self.sets[i] for i in rows]) if len(rows) else np.empty(0, np.uint64)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.rows = shingles[order], np.repeat(rows, self.sizes[rows])[order]
        self.indexed = len(rows)

    def linked(self, wanted: np.ndarray) -> np.ndarray:
        """The rows whose sets are similar enough to ``wanted``."""
        low, high = (np.searchsorted(self.shingles, wanted, side) for side in ("left", "right"))
        counts = high - low
        at = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
        shared = np.bincount(self.rows[at], minlength=len(self.sets))
        near = np.flatnonzero(shared)
        return near[shared[near] >= MIN_JACCARD * (self.sizes[near] + len(wanted) - shared[near])]

    def spanning(self) -> Iterator[tuple[int, int]]:
        """Links that connect all sets that links connect; those reached leave the index, until restore()."""
        todo = np.ones(len(self.sets), bool)
        left = len(self.sets)
        for start in range(len(self.sets)):
            if not todo[start]:
                continue
            todo[start], left = False, left - 1
            front = [start]
            while front and left:
                if 2 * left < self.indexed:
                    self._index(np.flatnonzero(todo))
                row = front.pop()
                reached = self.linked(self.sets[row])
                reached = reached[todo[reached]]
                todo[reached] = False
                left -= len(reached)
                front.extend(reached.tolist())
                yield from ((row, other) for other in reached.tolist())

    def restore(self) -> None:
        self._index(np.arange(len(self.sets)))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the indexed rows of each cell, and between them and the rows that pass by; rows come cell by cell, the indexed first."""
    cell, nodes, sets, index, labels = None, [], [], None, np.empty(0, np.int64)
    found: list[tuple[int, int]] = []

    def close() -> None:
        nonlocal index, labels
        index = Indexed(sets)
        labels = np.arange(len(sets))
        for a, b in index.spanning():
            found.append((nodes[a], nodes[b]))
            labels[b] = labels[a]  # a was reached before b, so its label is its tree's

    for clouds, parts, passing, ids, texts in slices(batches):
        for cloud, part, passes, node, text in zip(clouds, parts, passing, ids, texts, strict=True):
            if (cloud, part) != cell:
                if index is None and len(sets) > 1:
                    close()
                cell, nodes, sets, index = (cloud, part), [], [], None
            hashes = shingle_hashes(words_of(text))
            if not passes:
                nodes.append(node)
                sets.append(hashes)
                continue
            if index is None:
                close()
                index.restore()
            near = index.linked(hashes)
            _, one_of_each = np.unique(labels[near], return_index=True)
            found.extend((node, nodes[i]) for i in near[one_of_each].tolist())
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        found.clear()
    if index is None and len(sets) > 1:
        close()
    a, b = zip(*found, strict=True) if found else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def clouds(made: DataFrame, tile: int = TILE) -> DataFrame:
    """``node, text_hash, size, cloud`` for the nodes of every cloud of two nodes or more; ``made`` is sketches(docs)."""
    distinct = cut_lineage(made.dropDuplicates(["fp"]).select("fp", "segments", "least"))
    near = partial(spanning_links, max_bits=CANDIDATE_BITS)
    met = cut_lineage(links_of_keys(distinct.mapInArrow(_key_rows, "key long, fp long"), tile, near, CANDIDATE_BITS))
    roots = components(met, many=True).distinct().select(F.col("node").alias("fp"), "root")
    nodes = made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"))
    placed = cut_lineage(nodes.join(roots, "fp", "left").select("node", "text_hash", "size", F.coalesce("root", "fp").alias("cloud")))
    several = placed.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).where("n > 1")
    return placed.join(several, "cloud").select("node", "text_hash", "size", "cloud", "all")


def links(made: DataFrame, docs: DataFrame, tile: int = TILE, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """``a, b``: links between nodes that connect all that links within clouds connect; ``made`` is sketches(docs)."""
    inside = clouds(made, tile).withColumn("parts", F.ceil(F.col("all") / cell_shingles).cast("int"))
    inside = cut_lineage(inside.select("node", "text_hash", "cloud", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")))
    wanted = F.broadcast(inside) if inside.count() <= BROADCAST_NODES else inside
    texts = cut_lineage(docs.select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["node"]).drop("text_hash"))
    # A text is indexed in its own part and passes by those after it.
    meets = F.explode(F.sequence("part", F.col("parts") - 1)).alias("at")
    cells = texts.select("cloud", meets, (F.col("at") != F.col("part")).alias("passes"), "node", "text")
    dealt = cells.repartition("cloud", "at").sortWithinPartitions("cloud", "at", "passes")
    return dealt.mapInArrow(_compared, "a long, b long").distinct()


def near_copies(docs: DataFrame, tile: int = TILE, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """``doc_id, text_hash, keeps`` for rows of ``doc_id, text_hash, text``: ``keeps`` holds for the least pair of each group."""
    made = cut_lineage(sketches(docs))
    roots = components(links(made, docs, tile, cell_shingles)).distinct()
    rows = made.select("doc_id", "text_hash", "node").join(roots, "node", "left")
    placed = cut_lineage(rows.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    keepers = least.select(F.col("root").alias("_root"), F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash"))
    # Met by root and pair, so that the rows of a large group are dealt over many tasks.
    same = (F.col("root") == F.col("_root")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return placed.join(keepers, same, "left").select("doc_id", "text_hash", F.col("_root").isNotNull().alias("keeps"))
