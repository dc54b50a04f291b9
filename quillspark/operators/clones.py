"""Clones: texts whose sets of normalised lines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised_lines, shape
from .lineage import written
from .usage import half_up


def line_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(set_id, key, members, total, lines)``: one row per different set of lines, with the least key that has it."""
    rows = df.select(F.col(key).alias("key"), normalised_lines(F.col(text)).alias("all")).select("key", F.size("all").alias("total"), F.array_sort(F.array_distinct("all")).alias("lines")).where(F.size("lines") > 0)
    hashed = rows.withColumn("set_id", F.sha2(F.array_join("lines", "\n"), 256))
    return hashed.groupBy("set_id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("members"), F.min_by("total", "key").alias("total"), F.min_by("lines", "key").alias("lines"))


def near(sets: DataFrame, least_share: float = 0.7, least_lines: int = 3, band: float = 1.3) -> DataFrame:
    """Pairs ``(a, b, similarity, shared)`` of different line sets: shared lines by the larger set, halves rounded up at two digits.

    Prefix filter: a pair that can reach the share has a line in common among each set's rarest lines, so
    only those are joined; a line that very many texts share is among the rarest of hardly any set. Both
    total line counts differ by the band's factor at most.
    """
    sets = written(sets.withColumn("n", F.size("lines")))
    lines = written(sets.select("key", "n", "total", F.explode("lines").alias("line")).withColumn("h", F.xxhash64("line")).drop("line"))
    freq = lines.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("f", "h"))
    # what is rounded up to the share is at least the share less half a hundredth
    floor = F.greatest(F.ceil(F.col("n") * (least_share - 0.005) - 1e-9), F.lit(1))
    rare = lines.join(freq, "h").withColumn("place", place).where(F.col("place") <= F.col("n") - floor + 1)
    a = rare.select("h", F.col("key").alias("a"), F.col("n").alias("na"), F.col("total").alias("ta"))
    b = rare.select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("total").alias("tb"))
    size = (F.least("na", "nb") >= F.greatest("na", "nb") * (least_share - 0.005) - 1e-9) & (F.greatest("ta", "tb") <= band * F.least("ta", "tb"))
    candidates = a.join(b, "h").where((F.col("a") < F.col("b")) & size).select("a", "b").distinct()
    full = candidates.join(sets.select(F.col("key").alias("a"), F.col("lines").alias("la")), "a").join(sets.select(F.col("key").alias("b"), F.col("lines").alias("lb")), "b")
    shared = full.select("a", "b", F.size(F.array_intersect("la", "lb")).alias("shared"), F.greatest(F.size("la"), F.size("lb")).alias("most"))
    rated = shared.withColumn("similarity", half_up(F.col("shared") / F.col("most"), 2))
    return rated.where((F.col("similarity") >= least_share) & (F.col("shared") >= least_lines)).select("a", "b", "similarity", "shared")


def shape_clusters(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(shape, members, first)`` of shapes that occur twice or more, shapes as digests."""
    return df.select(F.col(key).alias("key"), F.sha2(shape(F.col(text)), 256).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("first")).where("members > 1")
