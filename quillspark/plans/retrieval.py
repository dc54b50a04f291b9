"""Batch retrieval: typed sub-queries under one token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_test_file, matches_path, word_in
from ..functions.text import lines, text_or_empty
from ..operators import rank as R

MOST_QUERIES, CHARS_PER_TOKEN, LEAST_REST = 20, 3, 100


def decompose(query: str) -> list[str]:
    """One part for up to eight words; else two, cut at a connective in the middle third or in the middle."""
    words = query.split()
    if len(words) <= 8:
        return [query]
    low, high = int(len(words) * 0.35), int(len(words) * 0.65)
    at = next((i for i in range(low, high + 1) if words[i].lower() in {"and", "or", "with", "that", "which", "when", "where", "for"}), len(words) // 2)
    return [" ".join(words[:at]), " ".join(words[at:])]


def symbols(table: DataFrame, query: str, k: int = 20, file_pattern: str | None = None, kind: str | None = None) -> DataFrame:
    """``(key, text, score)`` of the best symbols by fielded BM25; test files count less."""
    if file_pattern:
        table = table.where(matches_path(F.col("file"), file_pattern))
    if kind:
        table = table.where(F.col("kind") == kind)
    fields = {"name": (F.col("name"), 5.0), "signature": (F.col("signature"), 2.5), "docstring": (F.col("docstring"), 1.5), "body": (F.substring(text_or_empty(F.col("source")), 1, 500), 0.5)}
    scored = R.bm25(table, "id", fields, query, boost=F.when(is_test_file(F.col("file")), 0.3).otherwise(1.0))
    best = R.gap_cutoff(scored, k, "score", "id")
    return best.join(table.select("id", F.concat_ws("\n", "file", "signature", F.substring("source", 1, 500)).alias("text")), "id").select(F.col("id").alias("key"), "text", "score")


def text(files: DataFrame, query: str, k: int = 50) -> DataFrame:
    """Lines that contain the query."""
    hit = files.select("path", F.posexplode(lines(F.col("text"))).alias("n", "line")).where(F.contains("line", F.lit(query)))
    return hit.select(F.concat_ws(":", "path", F.col("n") + 1).alias("key"), F.col("line").alias("text"), F.lit(1.0).alias("score")).orderBy("key").limit(k)


def references(files: DataFrame, name: str, k: int = 50) -> DataFrame:
    """Lines that hold the name as a whole word."""
    hit = files.select("path", F.posexplode(lines(F.col("text"))).alias("n", "line")).where(word_in(F.col("line"), name))
    return hit.select(F.concat_ws(":", "path", F.col("n") + 1).alias("key"), F.col("line").alias("text"), F.lit(1.0).alias("score")).orderBy("key").limit(k)


def retrieve(tables: dict[str, DataFrame], queries: list[dict], budget: int = 4000) -> DataFrame:
    """``(query_idx, key, text, score)`` of all sub-queries in order, within the budget.

    The first row that doesn't fit is cut to what is left if that is over ``LEAST_REST`` tokens; rows behind it go.
    """
    if not 0 < len(queries) <= MOST_QUERIES:
        raise ValueError(f"1 to {MOST_QUERIES} sub-queries")
    makers = {"symbols": lambda q: symbols(tables["symbols"], q["query"], q.get("top_k", 20), q.get("file_pattern"), q.get("kind")), "text": lambda q: text(tables["files"], q["query"]), "references": lambda q: references(tables["files"], q["symbol_name"])}
    parts = [makers[q["type"]](q).withColumn("query_idx", F.lit(i)) for i, q in enumerate(queries)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    cost = F.ceil(F.length("text") / CHARS_PER_TOKEN)
    order = Window.orderBy("query_idx", F.col("score").desc(), "key")
    # each sub-query is a top-k, so the window is over a bounded number of rows
    running = union.withColumn("cost", cost).withColumn("before", F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = F.lit(budget) - F.col("before")
    fits = running.where((F.col("cost") <= rest) | (rest > LEAST_REST))
    return fits.select("query_idx", "key", F.when(F.col("cost") <= rest, F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), (rest * CHARS_PER_TOKEN).cast("int"))).alias("text"), "score")
