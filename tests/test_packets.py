"""Packets written, damaged and read back."""

import glob

import pytest

from millrace.sources import packets as P


@pytest.fixture
def packet(spark, tmp_path):
    path = str(tmp_path / "packet")
    events = [(f"s{s}", n // 4, n, f'{{"n":{n},"t":"é\\n{s}"}}') for s in range(4) for n in range(10)]
    decisions = [(f"s{s}", c, c * 3, f"act {c}") for s in range(3) for c in range(3)]
    P.write_packet(
        spark.createDataFrame(events, "stream string, segment int, seq long, line string").repartition(5),
        spark.createDataFrame(decisions, P.SIDECAR), path,
    )
    return path, events, decisions


def problems(df):
    return sorted((r["stream"], r["segment"], r["problem"]) for r in df.collect())


def segment(path, stream, number):
    (name,) = glob.glob(f"{path}/segments/stream={stream}/segment={number}/part-*")
    for crc in glob.glob(f"{path}/segments/stream={stream}/segment={number}/.*.crc"):
        open(crc, "wb").close()
        __import__("os").remove(crc)
    return name


def test_a_sound_packet_gives_back_its_lines_in_order(spark, packet):
    path, events, decisions = packet
    found, told, bad = P.load(spark, path)
    assert [(r["stream"], r["segment"], r["line"]) for r in found.orderBy("stream", "segment", "position").collect()] == [(s, g, line) for s, g, _, line in events]
    assert sorted(map(tuple, told.collect())) == sorted(decisions) and problems(bad) == []


def test_a_wrong_byte_names_its_file(spark, packet):
    path, *_ = packet
    name = segment(path, "s1", 1)
    raw = bytearray(open(name, "rb").read())
    raw[3] ^= 1
    open(name, "wb").write(bytes(raw))
    __import__("os").remove(segment(path, "s2", 2))
    found, _, bad = P.load(spark, path)
    rows = {(r["stream"], r["segment"]): r for r in bad.collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {("s1", 1): "changed", ("s2", 2): "missing"}
    assert rows["s1", 1]["path"].endswith(name) and found.where("stream = 's1' AND segment = 1").count() == 0 and found.count() == 40 - 4 - 2


def test_streams_prune_files_before_they_are_opened(spark, packet):
    path, *_ = packet
    segment(path, "s3", 0)
    __import__("os").chmod(segment(path, "s3", 0), 0)
    found, told, bad = P.load(spark, path, ["s0", "s1"])
    assert found.count() == 20 and told.count() == 6 and problems(bad) == []
    assert "PartitionFilters: [" in (plan := P.read_segments(spark, path, __import__("pyspark").sql.functions.col("stream") == "s0")._jdf.queryExecution().toString())
    assert "stream" in plan.split("PartitionFilters: [")[1][:60]


def test_sums_that_do_not_hold(spark, packet):
    path, events, decisions = packet
    more = spark.createDataFrame([("s0", 3, 99, "late"), ("s9", 0, 0, "who")], P.SIDECAR)
    from pyspark.sql import functions as F

    more.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{path}/sidecars")
    assert problems(P.load(spark, path)[2]) == [("s0", None, "changed"), ("s9", None, "unlisted")]


def test_packed_segments_hold_the_bytes_of_the_files(spark, packet, tmp_path):
    path, events, decisions = packet
    other = str(tmp_path / "packed")
    P.write_packet(
        spark.createDataFrame(events, "stream string, segment int, seq long, line string").repartition(5),
        spark.createDataFrame(decisions, P.SIDECAR), other, packed=True,
    )
    of = lambda p: sorted((r["stream"], r["segment"], bytes(r["content"]), r["sha256"]) for r in P.read_segments(spark, p).collect())
    assert of(other) == of(path) and len(of(other)) == 12
    assert len(glob.glob(f"{other}/**/part-*", recursive=True)) < 30 and not glob.glob(f"{other}/segments")
    found, told, bad = P.load(spark, other, ["s0", "s3"])
    assert [(r["stream"], r["segment"], r["line"]) for r in found.orderBy("stream", "segment", "position").collect()] == [(s, g, line) for s, g, _, line in events if s in ("s0", "s3")]
    assert told.count() == 3 and problems(bad) == []


def test_a_packed_segment_changed_or_lost_is_named(spark, packet, tmp_path):
    from pyspark.sql import functions as F

    path, events, decisions = packet
    other = str(tmp_path / "packed")
    P.write_packet(spark.createDataFrame(events, "stream string, segment int, seq long, line string"), spark.createDataFrame(decisions, P.SIDECAR), other, packed=True)
    rows = spark.createDataFrame(spark.read.parquet(f"{other}/packed").collect(), "stream string, segment int, content binary")
    at = lambda s, n: (F.col("stream") == s) & (F.col("segment") == n)
    changed = F.when(at("s1", 1), F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content"))
    rows.where(~at("s2", 2)).withColumn("content", changed).write.mode("overwrite").parquet(f"{other}/packed")
    found, _, bad = P.load(spark, other)
    assert problems(bad) == [("s1", 1, "changed"), ("s2", 2, "missing")] and found.count() == 40 - 4 - 2
