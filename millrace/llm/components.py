"""Connected components of a large graph by alternating star contractions, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Rounds, cut_lineage

MAX_ROUNDS = 50
#: One link in so many connects nearly all, where links are many.
SAMPLE = 8


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One contraction: every node's neighbours are linked to the least of them and it.

    ``larger_only`` moves the larger neighbours only (large star), else the smaller ones and the node
    itself (small star). Hot nodes are aggregated before the shuffle; the least neighbours are dealt once
    more, so that adaptive execution can split the join back to the neighbours of a hot node.
    """
    if larger_only:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges  # a > b holds in every edge
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition("a", "m")
    moved = both.join(least, "a")
    if larger_only:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _settled(links: DataFrame) -> DataFrame:
    """Edges ``a > b`` of distinct links made into stars: every node but the least of its component has one edge, to that."""
    rounds = Rounds()
    for _ in range(MAX_ROUNDS):
        # A node with two edges down, or with one down and one up, is in no star yet.
        ends = links.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("b", F.lit(0), F.lit(1)))
        found = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if found.where("down > 1 OR down = 1 AND up = 1").isEmpty():
            return links
        links = rounds.next(_toward_least(_toward_least(links, larger_only=True), larger_only=False))
        # The shuffle files of past rounds are deleted once the JVM has found that nothing refers to them.
        links.sparkSession.sparkContext._jvm.System.gc()
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _contracted(links: DataFrame) -> DataFrame:
    """Fewer links of the same components: stars of one link in ``SAMPLE``, and the others between the stars that they join.

    Where links are many to a node, those of the sample alone connect nearly all that all connect.
    """
    stars = _settled(cut_lineage(links.where(F.pmod(F.xxhash64("a", "b"), F.lit(SAMPLE)) == 0)))
    of_a, of_b = (stars.select(F.col("a").alias(f"_{c}"), F.col("b").alias(f"_root_{c}")) for c in "ab")
    met = links.join(of_a, links["a"] == of_a["_a"], "left").join(of_b, links["b"] == of_b["_b"], "left")
    ends = met.select(F.coalesce("_root_a", "a").alias("x"), F.coalesce("_root_b", "b").alias("y")).where("x <> y")
    return cut_lineage(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).union(stars).distinct())


def components(edges: DataFrame, many: bool = False) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the least node that it can reach.

    Self-links and repeated or reversed edges do no harm; null ends are left out. The result is written
    to the shared folder after each round, so a lost executor costs at most one round. ``many`` says that there
    are many edges to a node: they are thinned out first.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropna().where("a > b")
    links = cut_lineage(links.distinct())
    links = _settled(_contracted(links) if many else links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
