"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on, the clock in UTC, and checkpoints deleted once nothing refers to them.

    Master and cluster settings are left to spark-submit unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read through Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The table that a loop carries from round to round, written to the shared folder and read back each time.

    A checkpoint also cuts the plan, but keeps the optimizer's estimate of its size, which joins multiply round by round; a written
    table is as large as it is. The table of the round before is deleted once the next is written; the last one stays.
    """

    def __init__(self) -> None:
        self.path: str | None = None

    def next(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(df.schema).parquet(self.path)
