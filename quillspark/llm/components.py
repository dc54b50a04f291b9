"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is joins and ``min`` aggregates over the edges: nothing is gathered per node, so a hub
with a third of all edges is summed before its shuffle and split in its joins. Rounds are written to
the shared folder, which cuts the lineage. The number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """Per node ``u`` of the edges ``(u, v)`` (longs, u <> v) that isn't the least of its component: ``(u, root)``.

    Edges may repeat and point either way. No edges give an empty table.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    while before[0]:
        now = written(_small_star(_large_star(now)).distinct(), "edges")
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))
