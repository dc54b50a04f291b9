"""Routes, links and metadata of web projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """The path's segments, without query, fragment and host."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.filter(F.split(bare, "/"), lambda s: s != "")


def route_of_file(path: Column) -> Column:
    """A route from a file's path: app and pages folders, route groups and the page file's own name go."""
    out = F.regexp_replace(path, r"^(src/)?(app|pages)/", "/")
    out = F.regexp_replace(out, r"/(page|layout|route|index)\.[jt]sx?$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\.[jt]sx?$", ""), r"/\([^/]+\)", "")
    return F.when(out == "", "/").otherwise(out)


def template_matches(template: Column, path: Column) -> Column:
    """Segment arrays: ``{x}`` stands for one segment, a last ``*`` for the rest."""
    fixed = F.filter(template, lambda s: s != "*")
    rest = F.array_contains(template, "*")
    fits = F.when(rest, F.size(path) >= F.size(fixed)).otherwise(F.size(path) == F.size(template))
    alike = F.forall(F.zip_with(fixed, F.slice(path, 1, F.greatest(F.size(fixed), F.lit(0))), lambda t, p: (t == p) | t.rlike(r"^\{.*\}$")), lambda x: F.coalesce(x, F.lit(False)))
    return fits & alike


def contracts(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """``calls (method, segments, ...)`` with the endpoints ``(method, template, endpoint)`` they match.

    Both meet on the method and the first segment; a template that begins with a parameter or ``*`` meets on the method
    and any first segment, and every call asks for both. So no side is sent to every task, however many there are.
    """
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    open_ = first("template").rlike(r"^\{.*\}$") | (first("template") == "*")
    e = endpoints.select(F.col("method").alias("m"), "template", "endpoint", F.when(open_, F.lit(None).cast("string")).otherwise(first("template")).alias("_first"))
    asked = calls.withColumn("_ask", F.explode(F.array(first("segments"), F.lit(None).cast("string"))))
    met = asked.join(e, (F.col("method") == F.col("m")) & F.col("_ask").eqNullSafe(F.col("_first")))
    return met.where(template_matches(F.col("template"), F.col("segments"))).drop("m", "template", "_first", "_ask")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def metadata_score(html: Column) -> Column:
    """Title 25 (ten characters), description 20 (fifty), image 20, canonical 15, twitter 10, structured data 10."""
    title = F.regexp_extract(html, r"(?i)<title>([^<]*)</title>", 1)
    description = F.regexp_extract(html, r"(?i)<meta name=\"description\" content=\"([^\"]*)\"", 1)
    has = lambda p: html.rlike(p)
    return (
        F.when(F.length(title) >= 10, 25).otherwise(0) + F.when(F.length(description) >= 50, 20).otherwise(0)
        + F.when(has(r'(?i)property="og:image"') & ~has(r"(?i)placeholder"), 20).otherwise(0) + F.when(has(r'(?i)rel="canonical"'), 15).otherwise(0)
        + F.when(has(r'(?i)name="twitter:'), 10).otherwise(0) + F.when(has(r"(?i)application/ld\+json"), 10).otherwise(0)
    )


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 40, "needs_work").otherwise("poor")
