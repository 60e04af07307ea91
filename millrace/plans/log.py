"""The driver's tables seen as event logs, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sequence
from millrace.session import table

#: Fixed value: rows of a log that a task sorts at most, unless a session has more. AQE deals by compressed bytes, of which a log's rows have few.
ROWS_A_TASK = 250_000


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one log for each user: session_id, seq, event_id, at_us, kind, value, k."""
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    n = table(spark, sf_dir, "events").count()  # from the footers alone
    if n > ROWS_A_TASK:
        raw = raw.repartition(max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK)), "session_id")
    return sequence.number(raw, "session_id", ["at_us", "event_id"])


LOG_SQL = """log AS (
  SELECT user_id AS session_id, event_id, epoch_us(ts) AS at_us, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
  FROM events
)"""


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as logs of snapshots: conv_id, turn, role, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
