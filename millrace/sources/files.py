"""Readers and writers of the formats that logs and packets come in, through Spark's own file access alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_lines(lines: DataFrame, schema: StructType | str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows of ``schema``, rejected lines with the reason); nothing is dropped in silence."""
    parsed = lines.withColumn("_row", F.from_json(line, with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    good = parsed.where(~bad).select("_row.*").drop("_corrupt")
    reason = F.when(F.trim(F.coalesce(line, F.lit(""))) == "", "empty").otherwise("malformed")
    return good, parsed.where(bad).select(F.col(line).alias("line"), reason.alias("reason"))


def with_corrupt(schema: StructType | str) -> str:
    ddl = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return f"{ddl}, _corrupt string"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path), schema)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """LF-framed segment files: ``path, position, line`` of each event line, numbered from 0; a last empty line is no event."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("position", "line")).where("line <> ''")


def write_lines(rows: DataFrame, line: Column, path: str, by: Sequence[str] = ()) -> None:
    """Rows as lines of text, in folders by the columns named."""
    rows.select(*by, line.alias("value")).write.partitionBy(*by).text(path)


def parse_checksums(lines: DataFrame, line: str = "value") -> DataFrame:
    """``sha256, name`` of SHA256SUMS lines; lines of another form give nulls."""
    form = r"^([0-9a-f]{64}) [ *](.+)$"
    part = lambda i: F.nullif(F.regexp_extract(line, form, i), F.lit(""))
    return lines.select(part(1).alias("sha256"), part(2).alias("name"))


def verify_checksums(sums: DataFrame, files: DataFrame) -> DataFrame:
    """``name, status`` of listed and found files (``name, content``): ok, changed, missing or unlisted."""
    found = files.select("name", F.sha2("content", 256).alias("_found"))
    both = sums.join(found, "name", "full_outer")
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("_found").isNull(), "missing").when(F.col("sha256") != F.col("_found"), "changed").otherwise("ok")
    return both.select("name", status.alias("status"))


def store_artifacts(files: DataFrame, path: str) -> None:
    """Content-addressed store: each content once, in folders by the first two digits of its digest."""
    digest = F.sha2("content", 256)
    once = files.select(digest.alias("sha256"), "content").dropDuplicates(["sha256"])
    once.withColumn("shelf", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("shelf").parquet(path)


def merge_sidecars(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Review records of two files: ``key``, the one record there is, or both and ``conflict``."""
    columns = [c for c in left.columns if c != key]
    a, b = (df.select(key, F.struct(*columns).alias(n)) for df, n in ((left, "_a"), (right, "_b")))
    both = a.join(b, key, "full_outer")
    conflict = F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.select(key, F.coalesce("_a", "_b").alias("m"), conflict.alias("conflict")).select(key, "m.*", "conflict")
