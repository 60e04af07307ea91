"""Draws that are held to a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import draws


def intervals_to_total(bursts: DataFrame, burst: str, seed: Column, n: str, total: str, atoms: DataFrame, atom: str, boundary: int, jitter: int) -> DataFrame:
    """``burst, nth, drawn, interval``: ``n`` intervals from 1 to ``boundary`` - 1 for each burst, which add up to ``total`` exactly.

    Each is a random one of ``atoms``, moved by up to ``jitter``. What is then lacking or too much is spread over the burst's intervals in a
    random order, each taking as much as its bounds allow: all at once, since what those before one can take is a
    running sum. ``interval`` is null throughout a burst whose total no intervals could make. ``atoms`` is a small table, numbered
    in one array.
    """
    pool = atoms.agg(F.array_sort(F.collect_list(F.round(atom).cast("long"))).alias("_pool"))
    stream = draws.seed_of(seed, "intervals")
    rows = bursts.select(burst, F.col(total).cast("long").alias("_total"), F.col(n).alias("_n"), stream.alias("_seed")).where("_n > 0")
    rows = rows.join(F.broadcast(pool)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("nth"))
    draw = lambda k: draws.draw32(F.col("_seed"), 3 * (F.col("nth") - 1) + k)
    value = F.get("_pool", draws.below(draw(1), F.size("_pool")).cast("int")) + draws.below(draw(2), F.lit(2 * jitter + 1)) - jitter
    drawn = rows.select(burst, "nth", "_total", F.greatest(F.lit(1), F.least(value, F.lit(boundary - 1))).cast("long").alias("drawn"), draw(3).alias("_order"))
    whole = Window.partitionBy(burst)
    lack = drawn.withColumn("_lack", F.col("_total") - F.sum("drawn").over(whole))
    room = F.when(F.col("_lack") > 0, boundary - 1 - F.col("drawn")).otherwise(F.col("drawn") - 1)
    before = Window.partitionBy(burst).orderBy("_order", "nth").rowsBetween(Window.unboundedPreceding, -1)
    spread = lack.withColumn("_room", room).withColumns({"_before": F.coalesce(F.sum("_room").over(before), F.lit(0)), "_all": F.sum("_room").over(whole)})
    size = F.abs("_lack")
    moved = F.greatest(F.lit(0), F.least(F.col("_room"), size - F.col("_before"))) * F.signum("_lack").cast("long")
    return spread.select(burst, "nth", "drawn", F.when(F.col("_all") >= size, F.col("drawn") + moved).cast("long").alias("interval"))
