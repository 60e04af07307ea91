"""Two lanes for what comes in: lines that hold the schema, and the others as they came, each with its reason."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder

REASONS = ("malformed_json", "missing_field", "wrong_type")


def judged(lines: DataFrame, line: str, fields: dict[str, str]) -> DataFrame:
    """Add ``reason``, null for a good line, and ``parsed``, its fields.

    A line must be a JSON object with all ``fields``, given with their types; a null field is missing.
    """
    value = F.try_parse_json(line)
    of: Callable[[str, str], Column] = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    absent = [of(name, "variant").isNull() | F.is_variant_null(of(name, "variant")) for name in fields]
    strange = [of(name, kind).isNull() for name, kind in fields.items()]
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    reason = F.when(~is_object, REASONS[0]).when(F.array_max(F.array(*absent)), REASONS[1]).when(F.array_max(F.array(*strange)), REASONS[2])
    return lines.withColumn("reason", reason).withColumn("parsed", F.when(F.col("reason").isNull(), F.struct(*(of(n, k).alias(n) for n, k in fields.items()))))


def write_batch(judged_rows: DataFrame, batch_id: int, accepted: str, rejected: str) -> None:
    """One batch to both sinks. Each batch has a folder of its own, which a replay of the batch writes anew and so leaves as it was."""
    for sink, rows in ((accepted, judged_rows.where("reason IS NULL").drop("reason")), (rejected, judged_rows.where("reason IS NOT NULL").drop("parsed"))):
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")


def split(spark: SparkSession, rows: DataFrame, line: str, fields: dict[str, str], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The accepted and the rejected lane of a stream, run to the end of what there is; ``folder`` also holds its progress."""
    folder = folder or f"{shared_folder(spark)}/lanes-{uuid.uuid4().hex}"
    lanes = [f"{folder}/accepted", f"{folder}/rejected"]
    writer = judged(rows, line, fields).writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, *lanes))
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.parquet(lane) for lane in lanes)
