"""Logs as tables: usage and conversation lines, retrospectives, version-control output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RETRO_FIELDS, USAGE


def usage(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Usage events from JSON lines; lines that don't parse or lack time or tool are left out; the host defaults to the file's name."""
    rows = spark.read.schema(USAGE).option("mode", "PERMISSIVE").json(paths)
    host = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.jsonl?$", 1)
    return rows.where("ts is not null and tool is not null").withColumn("host", F.coalesce("host", F.when(host == "usage", "unknown").otherwise(host)))


def retros(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Retrospective lines of 17 tab-separated fields behind ``RETRO:``; other lines are left out."""
    fields = F.split(F.regexp_replace("value", r"^RETRO:\s*", ""), "\t")
    rows = spark.read.text(paths).where(F.col("value").startswith("RETRO:")).select(fields.alias("f")).where(F.size("f") == len(RETRO_FIELDS))
    numbers = {"turns_wasted", "tool_calls", "files_read", "files_modified"}
    return rows.select(*[(F.expr(f"try_cast(trim(f[{i}]) as int)") if n in numbers else F.trim(F.get("f", F.lit(i)))).alias(n) for i, n in enumerate(RETRO_FIELDS)])


def conversations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """User turns with the assistant turn after them: ``(session, user_at, question, answer)``.

    Content is a string or an array of blocks, whose texts are joined; turns without text (tool results) are skipped.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.timestamp").alias("at"), F.coalesce(F.get_json_object("value", "$.sessionId"), F.lit("")).alias("session"), F.get_json_object("value", "$.message.content").alias("content"))
    blocks = F.from_json("content", "array<struct<type:string,text:string>>")
    text = F.when(F.col("content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("content"))
    turns = raw.withColumn("text", text).where("type in ('user', 'assistant') and text is not null and trim(text) <> ''")
    order = Window.partitionBy("file", "session").orderBy("at")
    nxt = F.lead(F.struct("type", "text")).over(order)
    return turns.withColumn("next", nxt).where("type = 'user' and next.type = 'assistant'").select("session", F.col("at").alias("user_at"), F.col("text").alias("question"), F.col("next.text").alias("answer"))


def git_numstat(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(commit, file, added, removed)`` from ``git log --numstat --format=commit:%H`` output, one record a commit; binary counts are 0."""
    blocks = spark.read.option("lineSep", "commit:").text(paths).where(F.trim("value") != "")
    lines = blocks.select(F.trim(F.substring_index("value", "\n", 1)).alias("commit"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\d+|-)\t(\d+|-)\t(.+)$"), F.lit(0))).alias("line"))
    f = F.split("line", "\t", 3)
    number = lambda i: F.coalesce(F.expr(f"try_cast(split(line, '\\t', 3)[{i}] as int)"), F.lit(0))
    return lines.select("commit", F.get(f, F.lit(2)).alias("file"), number(0).alias("added"), number(1).alias("removed"))


def diff_hunks(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(file, start_line, end_line)`` of the new side's hunks in unified diffs; removals alone have an empty range."""
    files = spark.read.option("lineSep", "diff --git ").text(paths)
    named = files.select(F.regexp_extract("value", r"(?m)^\+\+\+ b/(.+)$", 1).alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^@@ -\S+ (\+\d+(?:,\d+)?) @@"), F.lit(1))).alias("h"))
    start, count = F.regexp_extract("h", r"\+(\d+)", 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("h", r",(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return named.where("file <> ''").select("file", start.alias("start_line"), (start + count - 1).alias("end_line"))


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a hunk of their file, once each."""
    h = hunks.select(F.col("file").alias("hf"), F.col("start_line").alias("hs"), F.col("end_line").alias("he"))
    return symbols.join(h, (F.col("file") == F.col("hf")) & (F.col("start_line") <= F.col("he")) & (F.col("hs") <= F.col("end_line")), "left_semi")
