"""Near-duplicate documents: SimHash fingerprints met by Golay-code fuzzy hashing.

Fingerprints of 64 bits are linked if at most three bits differ. Cut into four blocks of 16 bits, at
least one block of a linked pair is equal; of the other 48 bits, cut into two segments of 24, at least
one has at most one error. A fingerprint therefore gets, for each block and each of its two segments, the
equal block together with the names of the Golay codewords near the segment: about 25 keys, of which a
linked pair shares at least one. Keys are dealt to tasks and sorted; a task verifies the fingerprints of
a key against one another in numpy and hands on only the links of a spanning forest, never all pairs.

Equal fingerprints are one row from the start, however many documents share them. Keys are dealt by
ranges of (key, fingerprint), so a hot key is split over tasks; what may go on in another task, or is
longer than a tile, is handed on in tiles, and a key's tiles are verified two by two.

Cases, all defined: a null or empty text, or one of white space only, has fingerprint zero and is linked
like any other. Repeated rows share a component; a null id is the least id. An empty table gives an
empty result. Texts are hashed whole, however long. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_slices
from millrace.llm.components import components
from millrace.llm.golay import near_codewords
from millrace.session import cut_lineage

SEED = 42
MAX_BITS = 3
#: Fingerprints of one key that a task verifies together; of a larger key, two tiles at a time.
TILE = 16_384
#: Tiles of one key that meet all its others in one task.
TILES_OF_CELL = 4
#: Fixed value: how the 48 bits beside a block are cut into two segments of 24.
SEGMENT_BITS = 24


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        last = shingle_words - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:-last].tolist(), ends[last:].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's whole text, as a signed 64-bit number."""

    def make() -> Callable[..., dict]:
        def work(ids: list, texts: list) -> dict:
            made = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64)
            return {"doc_id": ids, "fp": made.view(np.int64)}

        return work

    return map_slices(docs.select(F.col(id_col).cast("long"), text_col), make, "doc_id long, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, as (row of ``fps``, key)."""
    rows, keys = [], []
    for block in range(4):
        shift = np.uint64(16 * block)
        equal = (fps >> shift & np.uint64(0xFFFF)).astype(np.int64)
        low = fps & np.uint64((1 << 16 * block) - 1)
        high = fps >> shift >> np.uint64(16)
        rest = (high << shift | low).astype(np.int64)
        for segment in range(2):
            row, name = near_codewords(rest >> SEGMENT_BITS * segment & (1 << SEGMENT_BITS) - 1)
            rows.append(row)
            keys.append((2 * block + segment) << 28 | equal[row] << 12 | name)
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(start, 4096).to_numpy(zero_copy_only=False)
            rows, keys = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all of ``fps`` that links connect, fewer than there are fingerprints.

    Grows one component at a time and compares its members with what no component has yet reached, so
    near copies by the thousand cost little more than their number.
    """
    todo = fps
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            some, front = front[:64], front[64:]
            near = np.bitwise_count(some[:, None] ^ todo[None, :]) <= max_bits
            reached = near.any(axis=0)
            if reached.any():
                yield some[near[:, reached].argmax(axis=0)], todo[reached]
                front, todo = np.concatenate([front, todo[reached]]), todo[~reached]


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("tile", pa.list_(pa.int64()))])
VERIFIED_DDL = "a long, b long, key long, tile array<long>"


def _handed_on(found: list[tuple[np.ndarray, np.ndarray]], tiles: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    empty, n = np.empty(0, np.uint64), len(tiles)
    a, b = (np.unique(np.stack([np.concatenate([empty, *(x[i] for x in found)]) for i in range(2)]), axis=1)).view(np.int64)
    columns = [
        pa.concat_arrays([pa.array(a), pa.nulls(n, pa.int64())]),
        pa.concat_arrays([pa.array(b), pa.nulls(n, pa.int64())]),
        pa.array([None] * len(a) + [int(key) for key, _ in tiles], pa.int64()),
        pa.array([None] * len(a) + [fps.view(np.int64) for _, fps in tiles], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=VERIFIED)


def _verifier(tile: int, near_of: Callable = spanning_links, max_bits: int = MAX_BITS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verify each run of one key in rows sorted by key and fingerprint.

    A run that may go on in a neighbouring task, or is longer than a tile, is verified tile by tile and
    its tiles are handed on, to be met with the key's others.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        shared = True  # whether the first run may have rows elsewhere

        def verified(upto: int, ended: bool) -> pa.RecordBatch:
            """The runs of the first ``upto`` rows; ``ended`` if no row comes after them."""
            edges = np.concatenate([[0], np.flatnonzero(keys[1:upto] != keys[: upto - 1]) + 1, [upto]])
            lengths = np.diff(edges)
            apart = lengths > tile
            apart[0] |= shared
            apart[-1] |= ended
            pair = edges[:-1][(lengths == 2) & ~apart]
            near = np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= max_bits
            found, tiles = [(fps[pair][near], fps[pair + 1][near])], []
            for i in np.flatnonzero((lengths > 2) | apart):
                for start in range(edges[i], edges[i + 1], tile):
                    run = fps[start : min(start + tile, edges[i + 1])]
                    found.extend(near_of(run))
                    if apart[i]:
                        tiles.append((keys[start], run))
            return _handed_on(found, tiles)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            upto, goes_on = int(np.searchsorted(keys, keys[-1])), False
            if len(keys) - upto > tile:  # the last run is too long to wait for its end
                upto, goes_on = len(keys), True
            if upto:
                yield verified(upto, goes_on)
                keys, fps, shared = keys[upto:], fps[upto:], goes_on
        if len(keys):
            yield verified(len(keys), True)

    return verify


def _meeting(near_of: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                both = np.concatenate([np.array(left.values), np.array(right.values)]).view(np.uint64)
                found = _handed_on(list(near_of(both)), [])
                yield found.select(["a", "b"])

    return meet


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all that links of at most three bits connect."""
    return links_of_keys(cut_lineage(fps.select("fp").distinct()).mapInArrow(_key_rows, "key long, fp long"), tile)


def links_of_keys(keyed: DataFrame, tile: int = TILE, near_of: Callable = spanning_links, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: what ``near_of`` links among the fingerprints of each key of ``keyed(key, fp)``."""
    # Ranges of (key, fingerprint) split a hot key over as many tasks as its rows need.
    dealt = keyed.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    out = cut_lineage(dealt.mapInArrow(_verifier(tile, near_of, max_bits), VERIFIED_DDL))
    tiles = out.where("key IS NOT NULL").select("key", "tile", F.element_at("tile", 1).alias("first"))
    # A key of many tiles is met in as many cells as it has handfuls of tiles: each right tile is in one, the left ones in all.
    cells = tiles.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILES_OF_CELL).cast("int").alias("cells"))
    tiles = cut_lineage(tiles.join(cells.where("cells > 1"), "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1))))
    cell = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")
    left = tiles.select("key", F.col("first").alias("i"), F.col("tile").alias("left"), cell)
    right = tiles.select("key", F.col("first").alias("j"), F.col("tile").alias("right"), F.pmod(F.xxhash64("first"), "cells").cast("int").alias("cell"))
    met = left.join(right, ["key", "cell"]).where("i < j").select("left", "right").mapInArrow(_meeting(near_of), "a long, b long")
    return out.where("key IS NULL").select("a", "b").union(met).distinct()


def components_of(prints: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for rows of fingerprints(): the least id that links reach."""
    prints = cut_lineage(prints)
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id"))).alias("least"))
    roots = components(links(prints))
    placed = cut_lineage(
        least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "least")
    )
    named = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("component")))
    of_print = cut_lineage(placed.join(named, "root").select("fp", F.col("component.doc_id").alias("component_id")))
    return prints.join(of_print, "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    return components_of(fingerprints(docs, shingle_words, id_col, text_col))
