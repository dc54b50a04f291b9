"""Co-change: items that appear in the same baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written


def pairs(baskets: DataFrame, basket: str, item: str, support: int = 3, jaccard: float = 0.3, most: int = 50) -> DataFrame:
    """``(a, b, together, jaccard)`` of item pairs a < b. Baskets of over ``most`` items are no evidence (as in the definition), so pairs per basket are bounded."""
    once = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    small = once.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= most) & (F.col("n") > 1)).select("basket")
    single = once.groupBy("item").agg(F.count(F.lit(1)).alias("support"))
    kept = once.join(small, "basket", "left_semi")
    a, b = kept.select("basket", F.col("item").alias("a")), kept.select("basket", F.col("item").alias("b"))
    both = a.join(b, "basket").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= support)
    joined = both.join(single.select(F.col("item").alias("a"), F.col("support").alias("sa")), "a").join(single.select(F.col("item").alias("b"), F.col("support").alias("sb")), "b")
    return joined.withColumn("jaccard", F.col("together") / (F.col("sa") + F.col("sb") - F.col("together"))).where(F.col("jaccard") >= jaccard).select("a", "b", "together", "jaccard")


def clusters(links: DataFrame) -> DataFrame:
    """``(node, cluster)``: the least node each can reach. Labels pass to neighbours and on to the labels' labels until none changes."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    label = written(both.select(F.col("u").alias("node")).distinct().withColumn("cluster", F.col("node")))
    while True:
        seen = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("cluster").alias("m"))
        closer = written(label.join(seen, label["node"] == seen["u"]).select("node", F.least("cluster", "m").alias("cluster"), (F.col("m") < F.col("cluster")).alias("moved")))
        if closer.where("moved").isEmpty():
            return closer.select("node", "cluster")
        jump = closer.select(F.col("node").alias("p"), F.col("cluster").alias("q"))
        label = written(closer.join(jump, closer["cluster"] == jump["p"]).select("node", F.col("q").alias("cluster")))
