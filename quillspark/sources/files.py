"""Source trees as tables, through Spark's own file readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_noise
from ..schemas import LANGUAGES

LARGEST = 1_000_000


def language_of(path: Column) -> Column:
    """The language by extension; ``unknown`` for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def scan(spark: SparkSession, root: str, glob: str | None = None, largest: int = LARGEST) -> DataFrame:
    """``(path, language, mtime_ms, bytes, sha1, text)`` of a tree's files; large, generated and binary files left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root).where(F.col("length") <= largest)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    text = F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string")
    out = rows.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("bytes"), F.sha1("content").alias("sha1"), text.alias("text"))
    return out.where(~is_noise(F.col("path")) & ~F.contains("text", F.lit("\u0000"))).withColumn("language", language_of(F.col("path")))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``(file, package, dependency, version, dev)`` of every package.json under a root."""
    text = scan(spark, root, "package.json").select("path", F.from_json("text", "name string, dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    runtime = text.select(F.col("path").alias("file"), F.col("m.name").alias("package"), F.explode("m.dependencies").alias("dependency", "version"), F.lit(False).alias("dev"))
    dev = text.select(F.col("path").alias("file"), F.col("m.name").alias("package"), F.explode("m.devDependencies").alias("dependency", "version"), F.lit(True).alias("dev"))
    return runtime.unionByName(dev)


def catalogue(spark: SparkSession, url: str, schema: str = "public", **properties: str) -> DataFrame:
    """``(table_name, column_name, data_type, is_nullable)`` of a live Postgres schema, over JDBC."""
    query = f"(SELECT table_name, column_name, data_type, is_nullable FROM information_schema.columns WHERE table_schema = '{schema.replace(chr(39), chr(39) * 2)}') c"
    return spark.read.jdbc(url, query, properties=properties)
