"""Connected components of a link table by alternating stars.

A round hangs every node's larger neighbours on its smallest one (large star),
then every smaller neighbour and the node itself on the smallest of those (small
star). Both need a minimum per node, which combines before the shuffle, and a
join on the node, whose skewed partitions are split: no neighbourhood is ever
collected. The number of rounds grows with the logarithm of the nodes. Each
round's table is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.plans.lineage import cut_lineage

#: Far above log2 of any table; reaching it means wrong input, so it raises.
MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node to the smaller."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(low, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(low.withColumnRenamed("low", "dst")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every linked node but the roots; ``links``: ``src, dst``."""
    edges = cut_lineage(
        links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links"
    )
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        state = now
        edges = cut_lineage(_small_star(_large_star(edges)), "stars")
    raise RuntimeError("components did not settle")
