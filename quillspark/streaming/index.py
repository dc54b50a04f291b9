"""Incremental maintenance of the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan_refresh(files: DataFrame, index: DataFrame) -> DataFrame:
    """Per path what to do: keep (same time), touch (same hash), parse (changed, stale or new) or drop (gone)."""
    old = index.select("path", F.col("mtime_ms").alias("old_mtime"), F.col("sha1").alias("old_sha1"), F.col("stale").alias("stale"))
    both = files.select("path", "mtime_ms", "sha1").join(old, "path", "full_outer")
    action = (
        F.when(F.col("mtime_ms").isNull(), "drop").when(F.col("old_mtime").isNull() | F.coalesce("stale", F.lit(False)), "parse")
        .when(F.col("mtime_ms") == F.col("old_mtime"), "keep").when(F.col("sha1") == F.col("old_sha1"), "touch").otherwise("parse")
    )
    return both.select("path", action.alias("action"))


def replaced(table: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """``table`` without the keys of ``gone`` and of ``fresh``, plus ``fresh``."""
    out = gone.select(key).union(fresh.select(key)).distinct()
    return table.join(out, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def dirty_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Other files to parse again: those whose text names a changed file's base name as a word.

    A file has changed if a symbol's (name, kind, signature) appeared in it or went.
    """
    print_of = lambda df: df.select("file", F.sha2(F.concat_ws("|", "name", "kind", "signature"), 256).alias("h"))
    a, b = print_of(old), print_of(new)
    changed = a.join(b, ["file", "h"], "left_anti").select("file").union(b.join(a, ["file", "h"], "left_anti").select("file")).distinct()
    named = changed.select(F.col("file").alias("changed"), F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("word"))
    words = files.select("path", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_-]+"))).alias("word"))
    return words.join(named, "word").where("path <> changed").select("path").distinct()


def latest(events: DataFrame, key: str = "path", time: str = "ts") -> DataFrame:
    """Of each key's file events the last one: deletions cancel updates before them."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def embeddings_to_refresh(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id, text, hash)`` of texts without a stored vector of the same hash."""
    return texts.join(stored.select("id", "hash"), ["id", "hash"], "left_anti")


def upsert(path: str, key: str = "path"):
    """A ``foreachBatch`` function that keeps a Parquet table at ``path``: a batch's keys replace the stored ones.

    The new table is written beside the old one and named in a pointer file by Spark's own writer, so that a
    failed batch leaves the old table in place and can be run again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, key) if "ts" in batch.columns else batch.dropDuplicates([key])
        old = current(spark, path)
        out = fresh if old is None else replaced(old, fresh, fresh.limit(0), key)
        out.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_pointer={batch_id}")

    return run


def current(spark, path: str) -> DataFrame | None:
    """The table that the latest complete batch left, or nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    done = [int(n.split("=")[1]) for n in names if n.startswith("_pointer=")]
    return spark.read.parquet(f"{path}/version={max(done)}") if done else None
