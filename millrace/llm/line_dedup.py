"""Line deduplication by range-partitioned hashes, with compressed keep bitmaps instead of text as the result.

Every line becomes a 128-bit hash of its key; the hashes of a document are written once, in one row, and
every later step reads those. The hashes are range-partitioned by (hash, document), so that equal lines
lie side by side in document order while one very common line still spreads over as many tasks as its
rows need. A secondary sort by text and position streams the first occurrence in each document; those are
counted within their task and only the counts are shuffled.

Lines are met with the common keys in two ways. Keys in more than a hundred-thousandth of all lines (and
``HOT_DOCS`` at least) are a hundred thousand at most, so they are broadcast and their lines stay where they are;
every other key is small and met by a shuffle of hashes. What comes back to the documents is, for each that
loses a line, a bitmap of which only the words with a lost line are stored.

Cases, all defined: a null or empty text is one empty line. Keys shorter than ``min_chars`` code
points are never dropped. Rows that share id and text are one document and get equal bitmaps; rows
that share an id but differ in text are told apart by a text hash, and count as one document. A null
id is one further document. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import line_key
from millrace.session import cut_lineage

DROP_ALL = "all"
KEEP_FIRST = "first"
#: A key is hot in more documents than this and than a hundred-thousandth of all lines; so there are 100,000 hot keys at most.
HOT_DOCS, HOT_KEYS = 1_000, 100_000
#: Bitmaps are broadcast up to so many rows and 64-bit words, about 16 MB; beyond, they are met with the texts by a shuffle.
BROADCAST_ROWS, BROADCAST_WORDS = 200_000, 1_000_000
#: The column that apply_bitmaps() adds unless told otherwise.
RESULT = "line_dedup"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc, text_hash, hashes array<struct<h1, h2>>``: one entry for each line, null for a key that is too short."""
    keys = F.transform(_lines(F.col(text_col)), line_key)
    hashed = F.transform(
        keys,
        lambda key: F.when(
            F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
        ),
    )
    return docs.select(F.col(id_col).alias("doc"), _text_hash(F.col(text_col)).alias("text_hash"), hashed.alias("hashes"))


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """``h1, h2, n_docs, first``: the keys of ``min_docs`` documents or more, and their first line by document and position."""
    # The range exchange keeps a hash's rows of one document together, so the window needs no further one.
    run = Window.partitionBy("h1", "h2", "doc").orderBy("text_hash", "pos")
    occurrences = lines.repartitionByRange("h1", "h2", "doc").withColumn("nth", F.row_number().over(run))
    counted = (
        occurrences.where(F.col("nth") == 1)
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "text_hash", "pos")).alias("first"))
    )
    return counted.where(F.col("n_docs") >= min_docs)


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    mode: str = DROP_ALL,
) -> DataFrame:
    """Bitmaps of the documents that lose a line: ``doc, text_hash, kept map<int, long>``.

    A key found in at least ``min_docs`` documents loses all its lines (``mode="all"``) or all but
    the first by document and position (``mode="first"``). Bit b of ``kept[w]`` stands for line 64 * w + b
    and is 1 where it stays; the lines of absent words stay, as do all of absent documents.
    """
    if mode not in (DROP_ALL, KEEP_FIRST):
        raise ValueError(f"mode is {mode!r}")
    hashed = cut_lineage(line_hashes(docs, id_col, text_col, min_chars))
    n_lines = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    lines = (
        hashed.select("doc", "text_hash", F.posexplode("hashes").alias("pos", "h"))
        .where("h IS NOT NULL")
        .select("h.h1", "h.h2", "doc", "text_hash", "pos")
    )
    common = cut_lineage(common_keys(lines, min_docs))
    hot = F.col("n_docs") > max(HOT_DOCS, n_lines // HOT_KEYS)
    few, many = (common.where(c).select("h1", "h2", "first") for c in (hot, ~hot))
    # Lines of hot keys are decided where they stand; only the others are shuffled to their keys.
    here = lines.join(F.broadcast(few.select("h1", "h2", F.col("first").alias("hot_first"))), ["h1", "h2"], "left")
    lost = here.where("hot_first IS NOT NULL").withColumnRenamed("hot_first", "first").unionByName(
        here.where("hot_first IS NULL").drop("hot_first").join(many, ["h1", "h2"])
    )
    if mode == KEEP_FIRST:
        lost = lost.where(~F.struct("doc", "text_hash", "pos").eqNullSafe(F.col("first")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)).cast("int"))
    return (
        lost.groupBy("doc", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("keep"))
        .groupBy("doc", "text_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "keep"))).alias("kept"))
    )


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: str = RESULT
) -> DataFrame:
    """``docs`` with the column ``result`` added, or put anew: ``struct<n_lines, n_dropped, kept_text>``.

    ``kept_text`` is null where the text is null and no line was dropped.
    """
    bitmaps = cut_lineage(bitmaps)
    size = bitmaps.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("kept")).alias("words")).first()
    all_kept = F.lit(-1).cast("long")
    bits = bitmaps.select(F.col("doc").alias("_bitmap_doc"), F.col("text_hash").alias("_bitmap_text"), F.col("kept").alias("_bitmap"))
    small = size["rows"] <= BROADCAST_ROWS and (size["words"] or 0) <= BROADCAST_WORDS
    bits = F.broadcast(bits) if small else bits.hint("shuffle_hash")
    on = docs[id_col].eqNullSafe(bits["_bitmap_doc"]) & (_text_hash(docs[text_col]) == bits["_bitmap_text"])
    # Opened to an array of words after the join: the lines below look their word up by its place.
    last = F.array_max(F.map_keys("_bitmap"))
    opened = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at("_bitmap", w), all_kept))
    joined = docs.join(bits, on, "left").withColumn("_bitmap_words", F.when(F.col("_bitmap").isNotNull(), opened))
    lines = _lines(F.col(text_col))

    def stays(_: Column, i: Column) -> Column:
        word = F.coalesce(F.get("_bitmap_words", F.floor(i / 64).cast("int")), all_kept)
        return F.getbit(word, F.pmod(i, F.lit(64)).cast("int")) == 1

    kept = F.when(F.col("_bitmap_words").isNotNull(), F.filter(lines, stays))
    made = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.when(kept.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(kept, "\n"), F.col(text_col)).alias("kept_text"),
    )
    return joined.withColumn(result, made).drop("_bitmap_doc", "_bitmap_text", "_bitmap", "_bitmap_words")
