"""Running a stream over what lies in a folder, batch by batch, and to the end of its event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder

#: Map state and event-time timers need a store that holds more than one value for a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet file or folder at ``path``, through Spark's readers alone."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    status = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = status.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(status).isFile()
    return reader.option("pathGlobFilter", name).parquet(parent) if is_file else reader.parquet(path)


def to_the_end(
    spark: SparkSession, rows: DataFrame, at_ms: str, last_ms: int, process: Callable[[DataFrame], DataFrame], delay: str = "0 seconds"
) -> DataFrame:
    """What ``process`` makes of the stream ``rows``, written out and read back, event time going on to ``last_ms``.

    ``process`` gets the rows with ``event_time``, on which the watermark lies. When all rows there are have been read, one
    tick at ``last_ms``, a row of nulls else, moves the watermark on, and timers that were due until then expire. Results and
    progress lie in the shared folder, so a restarted query goes on where it stopped.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    tick = spark.createDataFrame([], rows.schema)
    tick.write.parquet(f"{folder}/ticks")
    ticks = spark.readStream.schema(rows.schema).parquet(f"{folder}/ticks")
    timed = rows.unionByName(ticks).withColumn("event_time", F.timestamp_millis(at_ms)).withWatermark("event_time", delay)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        for turn in range(2):
            if turn:
                nulls = [F.lit(last_ms).cast(f.dataType).alias(f.name) if f.name == at_ms else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
                spark.range(1, numPartitions=1).select(*nulls).write.mode("append").parquet(f"{folder}/ticks")
            writer = process(timed).writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress")
            writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{folder}/out")
