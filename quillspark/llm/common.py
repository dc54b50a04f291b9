"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under ``sf_dir``, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where a single machine runs everything.

    A session on several machines that names no such folder is an error: a local folder would lose rows there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing.

    This runs a job at once. The tables stay until :func:`forget`, since results are read from them later.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results not yet read or written are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: 64-bit words of the bitmap that stands for a set of keys: 16.8 million bits, some 10 MB where it is broadcast.
WORDS = 1 << 18


def possibly(rows: DataFrame, key: list[Column], keys: DataFrame, words: int = WORDS) -> DataFrame:
    """``rows`` with ``_maybe``: false if the key isn't a row of ``keys``, true if it is, or rarely by chance.

    ``keys`` becomes a bitmap over its hashed values. It is broadcast, and at most ``words`` rows long however many
    keys there are, so the plan is the same at every size: more keys only mean that more rows are marked by chance.
    """

    def at(k: list[Column]) -> tuple[Column, Column]:
        h = F.xxhash64(*k)
        return F.pmod(h, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))

    word, bit = at([F.col(c) for c in keys.columns])
    bitmap = written(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bitmap")
    word, bit = at(key)
    told = rows.withColumn("_at", word).join(F.broadcast(bitmap), F.col("_at") == F.col("_word"), "left")
    return told.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def _looked_up(rows: DataFrame, key: list[Column], keys: DataFrame, words: int, how: str) -> tuple[DataFrame, DataFrame]:
    """The rows that the bitmap rules out, and of the others those that a join with the keys leaves."""
    held = keys.select(*[F.col(c).alias(f"_held{i}") for i, c in enumerate(keys.columns)]).distinct()
    told = possibly(rows, key, held, words)
    maybe = told.where("_maybe").drop("_maybe").withColumns({f"_key{i}": k for i, k in enumerate(key)})
    same = [F.col(f"_key{i}").eqNullSafe(F.col(f"_held{i}")) for i in range(len(key))]
    return told.where("not _maybe").drop("_maybe"), maybe.join(held, same, how).drop(*[f"_key{i}" for i in range(len(key))])


def within(rows: DataFrame, key: list[Column], keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose key is a row of ``keys`` (columns of the same types). Only rows that the bitmap lets through are shuffled."""
    return _looked_up(rows, key, keys, words, "left_semi")[1]


def without(rows: DataFrame, key: list[Column], keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose key isn't a row of ``keys``. Rows that the bitmap rules out stay where they are read, the others are looked up."""
    ruled_out, looked_up = _looked_up(rows, key, keys, words, "left_anti")
    return ruled_out.unionByName(looked_up)


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let the session hand at most so many rows at a time to Arrow functions: whole documents are long rows.

    The setting stays: the stage's plan runs after its function has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def short_reads(spark: SparkSession, rows: int = 256) -> None:
    """Let the session read at most so many rows of a Parquet file at a time.

    At Spark's 4096 rows the column of texts takes arrays of tens of MB, doubled as they fill, and the heap grows with
    them. Stays, as in :func:`short_batches`; no result depends on it.
    """
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name, "4096")) > rows:
        spark.conf.set(name, str(rows))
