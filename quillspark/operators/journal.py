"""Notes that outlive a session: a journal, scratch pads and plans of steps, as one append-only table.

Each entry is a row ``(scope, kind, key, seq, at, body)``; nothing is rewritten, the latest entry of a key is what
holds. Tables are folders of Parquet files, so writers don't wait for each other; a reader sees whole entries only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "scope string, kind string, key string, seq long, at timestamp, body string"
KINDS = ["journal", "scratch", "plan", "step", "memory"]
STATUSES = ["pending", "in_progress", "completed", "failed", "skipped"]


def append(spark: SparkSession, path: str, scope: str, entries: list[tuple[str, str, str]]) -> None:
    """Add entries ``(kind, key, body)`` of one scope (a repository or session), in their order. Unknown kinds are an error."""
    if bad := {k for k, _, _ in entries} - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(bad)}")
    rows = spark.createDataFrame([(scope, kind, key, i, body) for i, (kind, key, body) in enumerate(entries)], "scope string, kind string, key string, i long, body string")
    now = F.current_timestamp()
    rows.select("scope", "kind", "key", (F.unix_micros(now) + F.col("i")).alias("seq"), now.alias("at"), "body").coalesce(1).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries."""
    return spark.read.schema(ENTRY).parquet(path)


def latest(entries: DataFrame) -> DataFrame:
    """The entry that holds of each scope, kind and key. Entries are summed up before they are shuffled."""
    held = entries.groupBy("scope", "kind", "key").agg(F.max(F.struct("seq", "at", "body")).alias("e"))
    return held.select("scope", "kind", "key", "e.seq", "e.at", "e.body")


def scratch(entries: DataFrame, scope: str, key: str | None = None) -> DataFrame:
    """The scratch pad of a scope, or one key of it."""
    mine = latest(entries.where((F.col("kind") == "scratch") & (F.col("scope") == scope)))
    return (mine if key is None else mine.where(F.col("key") == key)).select("key", "body", "at")


def plan(spark: SparkSession, path: str, scope: str, name: str, steps: list[str]) -> None:
    """A plan of pending steps: key ``name`` for the plan, ``name/1`` and so on for the steps."""
    append(spark, path, scope, [("plan", name, str(len(steps))), *[("step", f"{name}/{i}", f"pending\t{s}") for i, s in enumerate(steps, 1)]])


def set_status(spark: SparkSession, path: str, scope: str, name: str, step: int, status: str) -> None:
    """A step's new status. A step that isn't there, or an unknown status, is an error."""
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    known = plan_steps(read(spark, path), scope, name).where(F.col("step") == step).first()
    if known is None:
        raise ValueError(f"no step {step} in {name}")
    append(spark, path, scope, [("step", f"{name}/{step}", f"{status}\t{known['title']}")])


def plan_steps(entries: DataFrame, scope: str, name: str) -> DataFrame:
    """``(step, status, title)`` of a plan as it stands."""
    mine = latest(entries.where((F.col("kind") == "step") & (F.col("scope") == scope) & F.col("key").startswith(f"{name}/")))
    parts = F.split("body", "\t", 2)
    return mine.select(F.substring_index("key", "/", -1).cast("int").alias("step"), parts[0].alias("status"), parts[1].alias("title"))


def plans(entries: DataFrame) -> DataFrame:
    """``(scope, plan, steps, completed, status)`` of all plans."""
    steps = latest(entries.where("kind = 'step'")).select("scope", F.regexp_replace("key", "/[0-9]+$", "").alias("plan"), F.split("body", "\t")[0].alias("status"))
    done, failed = F.count_if(F.col("status").isin("completed", "skipped")), F.count_if(F.col("status") == "failed")
    status = F.when(failed > 0, "failed").when(done == F.count(F.lit(1)), "completed").when(F.count_if(F.col("status") != "pending") > 0, "in_progress").otherwise("pending")
    return steps.groupBy("scope", "plan").agg(F.count(F.lit(1)).alias("steps"), done.alias("completed"), status.alias("status"))
