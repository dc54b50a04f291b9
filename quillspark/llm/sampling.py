"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of all sampled texts together, so that very long texts can't fill the driver.
MOST_CHARS = 100_000_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, modulus: int, held_out: int, doc_id: str = "doc_id", text: str = "text", most_chars: int = MOST_CHARS) -> list[tuple[str, int]]:
    """``(text, label)`` of at most ``bound`` labelled rows outside the held-out remainder, least hash of the id first.

    The bounds are on rows and on characters: the sample ends before the text that would exceed ``most_chars``. So its
    size doesn't grow with the tables. Rows without a label or an
    id are no labelled rows; of several labels for one id the largest counts. The chosen ids (8 bytes each,
    ``bound`` at most) are broadcast, so that no text is shuffled.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).where("_id is not null and _y is not null")
    chosen = known.where(remainder(F.col("_id"), modulus) != held_out).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    plain = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    # an id that repeats among the documents could exceed the bound: one row of each
    rows = plain.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("_text", "_y")).alias("r")).select("_id", "r._text", "r._y")
    # one window over at most ``bound`` rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("_id"), "_id")
    rows = rows.withColumn("_chars", F.sum(F.length("_text").cast("long")).over(order)).where(F.col("_chars") <= most_chars).orderBy(F.xxhash64("_id"), "_id").collect()
    return [(r["_text"], r["_y"]) for r in rows]
