import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text[, lang[, source]]) rows."""

    def build(rows):
        full = [(i, t, *(more or ("en",))) for i, t, *more in rows]
        full = [(i, t, *rest, *["src0"] * (2 - len(rest)), len(t or "")) for i, t, *rest in full]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def odd_documents(documents):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\x0b\n\n", "en", "a"), (4, long, "en", "b"), (5, "Same text here.", "en", "a"),
        (5, "Same text here.", "en", "a"), (6, "Same text here.", None, None), (None, "No id but a text.", "de", "c"), (8, "é中\U0001f600 x", "fr", None),
    ]
    extra = {c: F.lit(7) for c in ("size", "target", "fp", "h1", "doc", "words", "bucket", "gap", "key", "lines", "line_dedup", "held_out", "score")}
    return documents(rows).withColumns(extra)
