"""A training corpus from raw documents in five stages, each written out and read again by the next.

Cases, all defined: a row is judged by its text, or by its id and text together, nulls alike; so rows that share an
id, or have none, each get their own verdict, and rows equal in both stay or go together (``near_copies`` keeps one).
A null or empty text has no language and goes with the first stage; later stages take it as an empty text. Of ties,
the least id and then the least text hash stays, a null id being the least, so reruns agree. Columns beyond those of
documents pass through unchanged, whatever their names; names that begin with ``_stage_`` are the stages' own.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, line_dedup, mixing, quantiles, shingle_copies
from millrace.llm.text import held_out
from millrace.session import cut_lineage, table

#: A document is in no known language if its distance to the nearest profile is more than ``LANGUAGE_MARGIN`` over that
#: of all but the farthest hundredth of the learned documents of this language, of its length class or of all, whichever is larger.
LANGUAGE_QUANTILE, LANGUAGE_MARGIN = 0.99, 0.15
#: Learned documents of one language and length class from which the class has a limit of its own.
CLASS_DOCS = 20
REPEATED_LINE_DOCS = 10
#: Up to so many pairs of 16 bytes are broadcast.
BROADCAST_IDS = 500_000
MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS = (5, 2, 1), 1.5, 2.0
#: What the last stage adds: which repetition of its document a row is, and its source's target in words.
COPY, TARGET = "mix_copy", "mix_target_words"
#: Columns that a stage adds for its own use and drops again.
TEXT_HASH, OTHER_HASH, LINES = "_stage_text_hash", "_stage_other_hash", "_stage_lines"


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def other_hash(text: Column) -> Column:
    """A second hash of 64 bits: with the first, no two texts of a corpus are taken for one."""
    return F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))


def _without_texts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is among ``hashes(doc_id, OTHER_HASH)``, for verdicts that the text alone decides.

    A list of proven length is broadcast, so the texts stay where they are; a longer one is shuffled.
    """
    named = cut_lineage(hashes.select(F.col("doc_id").alias("_stage_hash"), F.col(OTHER_HASH).alias("_stage_hash2")).distinct())
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    same = (text_hash(docs["text"]) == named["_stage_hash"]) & (other_hash(docs["text"]) == named["_stage_hash2"])
    return docs.join(named, same, "left_anti")


def _by_pair(hashed: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """``hashed``, documents with TEXT_HASH, that are (``left_semi``) or are not (``left_anti``) among ``pairs(doc_id, text_hash)``."""
    named = cut_lineage(pairs.select(F.col("doc_id").alias("_stage_id"), F.col("text_hash").alias("_stage_hash")).distinct())
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    on = hashed["doc_id"].eqNullSafe(named["_stage_id"]) & (hashed[TEXT_HASH] == named["_stage_hash"])
    return hashed.join(named, on, how)


def language_limits(found: DataFrame) -> DataFrame:
    """``lang_pred, size, most``: the largest distance of each language by length class, and of all its lengths where ``size`` is null.

    Only learned documents whose nearest profile is their own language count. There is a row for each language and class.
    """
    own = found.where(F.col("learned") & (F.col("lang") == F.col("lang_pred")))
    by_class = quantiles.ends(own, ["lang_pred", "size"], "distance", 0.0, LANGUAGE_QUANTILE).where(F.col("n") >= CLASS_DOCS)
    of_all = quantiles.ends(own, ["lang_pred"], "distance", 0.0, LANGUAGE_QUANTILE)
    both = by_class.unionByName(of_all.withColumn("size", F.lit(None).cast("int")))
    return cut_lineage(both.select("lang_pred", "size", (F.col("high") + LANGUAGE_MARGIN).alias("most")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and those farther from every profile than its learned documents of such length.

    A null or empty text has no letter. Where no language is labelled, every document with a letter is rejected as unknown.
    """
    is_learned = ~held_out(F.col("doc_id"))
    profiles = language_id.fit(docs.where(is_learned))
    size = F.floor(F.log2(F.char_length("text") + 1)).cast("int")
    hashes = text_hash(F.col("text")).alias(TEXT_HASH), other_hash(F.col("text")).alias(OTHER_HASH)
    hashed = docs.select(*hashes, "text", "lang", is_learned.alias("learned"), size.alias("size"))
    found = cut_lineage(language_id.predict(hashed, profiles, TEXT_HASH, carry=f"{OTHER_HASH} long, lang string, learned boolean, size int"))
    limits = language_limits(found)
    of_all = limits.where("size IS NULL").select("lang_pred", F.col("most").alias("most_of_all"))
    of_class = limits.where("size IS NOT NULL").select("lang_pred", "size", F.col("most").alias("most_of_class"))
    judged = found.join(F.broadcast(of_all), "lang_pred", "left").join(F.broadcast(of_class), ["lang_pred", "size"], "left")
    most = F.greatest("most_of_all", "most_of_class")  # leaves nulls out
    wrong = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("distance") > F.coalesce(most, F.lit(LANGUAGE_MARGIN)))
    return _without_texts(docs, judged.where(wrong))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten documents or more, keep the first occurrence alone, by id, text hash and place; every document stays."""
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=REPEATED_LINE_DOCS, mode=line_dedup.KEEP_FIRST)
    done = line_dedup.apply_bitmaps(docs, bitmaps, result=LINES)
    new = {"text": F.col(LINES)["kept_text"]}
    if "n_chars" in docs.columns:
        changed = F.col(LINES)["n_dropped"] > 0
        new["n_chars"] = F.when(changed, F.char_length(new["text"]).cast("long")).otherwise(F.col("n_chars"))
    return done.select(*(new[c].alias(c) if c in new else c for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least id and text hash stays, once.

    Near copies have five-word shingles of Jaccard 0.8 or more. A null id is the least; rows that share an
    id but not the text are judged each by its own text.
    """
    hashed = docs.withColumn(TEXT_HASH, text_hash(F.col("text")))
    found = cut_lineage(shingle_copies.near_copies(hashed.select("doc_id", F.col(TEXT_HASH).alias("text_hash"), "text")))
    pair = ["doc_id", "text_hash"]
    kept = _by_pair(hashed, found.where(~F.col("keeps")), "left_anti")
    repeated = cut_lineage(found.where("keeps").groupBy(*pair).count().where("count > 1"))
    if not repeated.isEmpty():
        once = _by_pair(kept, repeated, "left_semi").dropDuplicates(["doc_id", TEXT_HASH])
        kept = _by_pair(kept, repeated, "left_anti").unionByName(once)
    return kept.drop(TEXT_HASH)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; null and empty texts and items hold nothing."""
    items = table(spark, sf_dir, "benchmark")
    hashed = docs.select(text_hash(F.col("text")).alias(TEXT_HASH), other_hash(F.col("text")).alias(OTHER_HASH), "text")
    return _without_texts(docs, decontamination.leaks(hashed, items, id_col=TEXT_HASH, carry=[OTHER_HASH]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of each document that the mix takes; a null source is a source, and rows alike are taken alike."""
    columns = [c for c in docs.columns if c not in (COPY, TARGET)]
    measured = cut_lineage(mixing.measure(docs))
    sources = mixing.plan_sources(measured, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    chosen = mixing.choose(measured, sources)
    rows = docs.select(F.struct(*columns).alias("doc")).select(
        "doc",
        F.col("doc.source").alias("source"),
        mixing.word_count(F.col("doc.text")).alias("size"),
        mixing.id_hash(F.col("doc.doc_id")).alias("id_hash"),
    )
    taken = mixing.repeat(rows, sources, chosen).where("repeats > 0")
    return taken.select(
        "doc.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias(COPY), F.col("target").alias(TARGET)
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("mixed", mixed),
]

#: Rank-order profiles, XXH64 fingerprints and BM25 retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is cut off from its lineage before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
