"""Packets: a manifest that names files with their digests, segments of events, and sidecars of decisions, bound together.

A packet is a folder of ``manifest/`` (JSON lines, one for each stream), ``segments/stream=<name>/segment=<number>/`` with one file
of LF-ended event lines each, and ``sidecars/`` (JSON lines, one for each decision). Files are opened by Spark's binary reader, one
row a file, so a packet of any number of files is dealt over the tasks, and a folder on any store that Spark reads will do.
Segments may also lie packed: ``packed/`` holds the bytes of one as a row of Parquet, for packets of so many small segments that a file of each is too dear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stream string, n_events long, n_decisions long, segments array<struct<segment:int,sha256:string>>, sidecar_sha256 string"
SIDECAR = "stream string, call_index long, observed_seq long, action string"


def write_packet(events: DataFrame, decisions: DataFrame, path: str, packed: bool = False) -> None:
    """Write ``events(stream, segment, seq, line)`` and ``decisions(stream, call_index, observed_seq, action)`` as a packet.

    A segment is one file, or if ``packed`` one row, and is written by one task in the order of ``seq``; its digest, like a sidecar's, is that of its
    lines, each ended by LF.
    """
    joined = lambda order, line: F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n"), F.lit("\n"))
    if packed:
        events.groupBy("stream", "segment").agg(joined("seq", "line").cast("binary").alias("content")).write.parquet(f"{path}/packed")
    else:
        ordered = events.repartition("stream", "segment").sortWithinPartitions("stream", "segment", "seq")
        ordered.select("stream", "segment", F.col("line").alias("value")).write.partitionBy("stream", "segment").text(f"{path}/segments")
    segments = events.groupBy("stream", "segment").agg(F.sha2(joined("seq", "line"), 256).alias("sha256"), F.count(F.lit(1)).alias("n"))
    by_stream = segments.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct(F.col("segment").cast("int").alias("segment"), "sha256"))).alias("segments"), F.sum("n").alias("n_events"))
    told = decisions.withColumn("_line", F.to_json(F.struct(*(c.split()[0] for c in SIDECAR.split(", ")))))
    sidecars = told.groupBy("stream").agg(F.sha2(joined("call_index", "_line"), 256).alias("sidecar_sha256"), F.count(F.lit(1)).alias("n_decisions"))
    manifest = by_stream.join(sidecars, "stream", "left").fillna(0, ["n_decisions"])
    manifest.select(F.to_json(F.struct(*(c.split()[0] for c in MANIFEST.split(", ")))).alias("value")).write.text(f"{path}/manifest")
    told.select(F.col("_line").alias("value")).write.text(f"{path}/sidecars")


def read_manifest(spark: SparkSession, path: str, manifest: str = "manifest") -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/{manifest}")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIDECAR).json(f"{path}/sidecars")


def read_segments(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """``stream, segment, path, content, sha256`` of the segments, in files or packed; ``wanted``, over stream and segment, prunes before any is opened."""
    packed = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/packed")
    if packed.getFileSystem(spark._jsc.hadoopConfiguration()).exists(packed):
        files = spark.read.parquet(f"{path}/packed").withColumn("path", F.col("_metadata.file_path"))
    else:
        files = spark.read.format("binaryFile").load(f"{path}/segments").withColumn("stream", F.col("stream").cast("string"))
    files = files if wanted is None else files.where(wanted)
    return files.select("stream", F.col("segment").cast("int").alias("segment"), "path", "content", F.sha2("content", 256).alias("sha256"))


def artifact_problems(manifest: DataFrame, segments: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``stream, segment, problem, path``: files that the manifest names and that are missing or changed, and files that it does not name.

    A sidecar's problem has no segment.
    """
    named = manifest.select("stream", F.explode("segments").alias("s")).select("stream", "s.segment", F.col("s.sha256").alias("_named"))
    met = named.join(segments.drop("content"), ["stream", "segment"], "full")
    problem = F.when(F.col("path").isNull(), "missing").when(F.col("_named").isNull(), "unlisted").when(F.col("_named") != F.col("sha256"), "changed")
    of_files = met.select("stream", "segment", problem.alias("problem"), "path").where("problem IS NOT NULL")
    lines = F.to_json(F.struct(*(c.split()[0] for c in SIDECAR.split(", "))))
    told = sidecars.withColumn("_line", lines).groupBy("stream").agg(
        F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_index", "_line"))), lambda x: x["_line"]), "\n"), F.lit("\n")), 256).alias("_found")
    )
    both = manifest.select("stream", F.col("sidecar_sha256").alias("_named"), F.lit(True).alias("_listed")).join(told, "stream", "full")
    bad = F.when(F.col("_listed").isNull(), "unlisted").when(F.col("_named").isNotNull() & F.col("_found").isNull(), "missing").when(~F.col("_named").eqNullSafe(F.col("_found")), "changed")
    return of_files.unionByName(both.select("stream", F.lit(None).cast("int").alias("segment"), bad.alias("problem"), F.lit(None).cast("string").alias("path")).where("problem IS NOT NULL"))


def events_of(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """``stream, segment, position, line`` of the segments whose digest is the manifest's; others give no event."""
    named = manifest.select("stream", F.explode("segments").alias("s")).select("stream", "s.segment", F.col("s.sha256").alias("sha256"))
    sound = segments.join(named, ["stream", "segment", "sha256"], "left_semi")
    lines = F.split(F.decode("content", "UTF-8"), "\n", -1)
    each = sound.select("stream", "segment", F.posexplode(lines).alias("position", "line"), F.size(lines).alias("_n"))
    return each.where(F.col("position") < F.col("_n") - 1).drop("_n")  # the piece after the last LF is no line


def load(spark: SparkSession, path: str, streams: Sequence[str] | None = None, manifest: str = "manifest") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, decisions and problems of a packet, or of some of its streams, by the manifest of the name given.

    Beside problems of artifacts there are those of sums: ``event_count`` and ``decision_count`` where a sound stream does not hold what its manifest says, and
    ``observed_beyond`` where a decision saw more events than there are.
    """
    wanted = None if streams is None else F.col("stream").isin(*streams)
    keep = (lambda df: df) if wanted is None else (lambda df: df.where(wanted))
    listed, sidecars = keep(read_manifest(spark, path, manifest)), keep(read_sidecars(spark, path))
    segments = read_segments(spark, path, wanted)
    problems = artifact_problems(listed, segments, sidecars)
    events = events_of(segments, listed)
    unsound = problems.where("problem <> 'unlisted'").select("stream").distinct()
    counted = listed.select("stream", "n_events", "n_decisions").join(unsound, "stream", "left_anti")
    counted = counted.join(events.groupBy("stream").agg(F.count(F.lit(1)).alias("_events")), "stream", "left")
    counted = counted.join(sidecars.groupBy("stream").agg(F.count(F.lit(1)).alias("_decisions"), F.max("observed_seq").alias("_seen")), "stream", "left").fillna(0, ["_events", "_decisions"])
    found = F.array(
        F.when(F.col("_events") != F.col("n_events"), "event_count"), F.when(F.col("_decisions") != F.col("n_decisions"), "decision_count"),
        F.when(F.col("_seen") >= F.col("_events"), "observed_beyond"),
    )
    sums = counted.select("stream", F.lit(None).cast("int").alias("segment"), F.explode(F.array_compact(found)).alias("problem"), F.lit(None).cast("string").alias("path"))
    return events, sidecars, problems.unionByName(sums)
