"""The code graph: call sites, call and import edges, references and unused names, over symbol tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words before a bracket that are no calls.
KEYWORDS = "if for while switch catch return function typeof new await async def class elif else except with lambda import from assert print raise super isinstance len range constructor require".split()
CALLABLE = ["function", "method", "component", "hook", "test_case"]


def call_sites(symbols: DataFrame) -> DataFrame:
    """``(id, callee, is_method)`` of names of three characters or more before a bracket, each once."""
    found = F.regexp_extract_all("source", F.lit(r"(?:\.|->|::)?\s*\b[A-Za-z_$][\w$]{2,}\s*(?:<[^<>()]*>)?\s*\("), F.lit(0))
    sites = symbols.where("source is not null").select("id", "name", F.explode(F.array_distinct(found)).alias("hit"))
    callee = F.regexp_extract("hit", r"([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*\($", 1)
    return sites.select("id", "name", callee.alias("callee"), F.col("hit").rlike(r"^(\.|->|::)").alias("is_method")).where(~F.col("callee").isin(KEYWORDS)).distinct()


def call_edges(symbols: DataFrame) -> DataFrame:
    """``(src, dst, inferred)``: free calls to every callable of that name; more than one target makes an edge inferred."""
    targets = symbols.where(F.col("kind").isin(CALLABLE)).select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    free = call_sites(symbols.where(F.col("kind").isin(CALLABLE))).where("not is_method").select(F.col("id").alias("src"), "callee")
    many = targets.groupBy("callee").agg((F.count(F.lit(1)) > 1).alias("inferred"))
    return free.join(targets, "callee").join(many, "callee").where("src <> dst").select("src", "dst", "inferred").distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair: runtime beats type-only, a star import sticks."""
    return edges.groupBy("src", "dst").agg(F.min("type_only").alias("type_only"), F.max("star_import").alias("star_import"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(src, dst, type_only, star_import)``: targets resolved to files of the tree, by module path without extension."""
    bare = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), r"/(index|__init__)$", "")
    known = files.select(F.col("path").alias("dst"), bare.alias("module"))
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    dotted = F.replace("target", F.lit("."), F.lit("/"))
    cleaned = F.regexp_replace("target", r"\.(js|ts|tsx|jsx|mjs)$", "")
    up = F.size(F.regexp_extract_all(cleaned, F.lit(r"\.\./"), F.lit(0)))
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), "/")
    relative = F.regexp_replace(F.concat_ws("/", base, F.regexp_replace(cleaned, r"^(\.\.?/)+", "")), "^/", "")
    module = F.when(F.col("target").startswith("./") | F.col("target").startswith("../"), relative).when(F.contains("target", F.lit("/")), cleaned).otherwise(dotted)
    edges = imports.select(F.col("file").alias("src"), module.alias("module"), "type_only", "star_import").join(known, "module").where("src <> dst")
    return merge_edges(edges)


def heritage_edges(symbols: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` from files to the one file that declares the class or interface named; ambiguous names give none."""
    homes = symbols.where("kind in ('class', 'interface')").groupBy("name").agg(F.min("file").alias("dst"), F.count_distinct("file").alias("n")).where("n = 1")
    uses = symbols.select("file", F.explode("`extends`").alias("name"), F.lit("extends").alias("kind")).unionByName(symbols.select("file", F.explode("`implements`").alias("name"), F.lit("implements").alias("kind")))
    return uses.join(homes, "name").where("file <> dst").select(F.col("file").alias("src"), "dst", "kind").distinct()


def dead_code(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Exported symbols whose name is a word of no other file."""
    words = files.select("path", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_$]+"))).alias("name"))
    spread = words.groupBy("name").agg(F.count_distinct("path").alias("n")).where("n > 1").select("name")
    return symbols.where("is_exported and kind not in ('test_case', 'test_suite', 'field')").join(spread, "name", "left_anti")


def unused_imports(files: DataFrame) -> DataFrame:
    """``(path, name)`` of Python and TypeScript names imported and not used again in the file."""
    block = r"(?m)^\s*import\s+(?:type\s+)?\{([^}]*)\}|^\s*from\s+[\w.]+\s+import\s+([\w, ]+)$"
    hits = files.select("path", "text", F.explode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("hit"))
    names = F.split(F.regexp_replace(F.regexp_replace("hit", r"(?s)^.*\{|\}.*$|^\s*from\s+[\w.]+\s+import\s+", ""), r"\s+", " "), ",")
    one = hits.select("path", "text", F.explode(names).alias("n")).select("path", "text", F.trim(F.regexp_replace("n", r"^.*\bas\s+|^\s*type\s+", "")).alias("name")).where("name rlike '^[A-Za-z_$][A-Za-z0-9_$]*$'")
    uses = F.size(F.filter(F.split("text", r"[^A-Za-z0-9_$]+"), lambda w: w == F.col("name")))
    return one.where(uses <= 1).select("path", "name").distinct()


def workspace_of(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``files`` with the workspace ``(name, root)`` of the longest root that holds the path, or null.

    A path asks for each of its folders, the longest match wins: an equi join, however many roots there are.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    w = workspaces.select(F.col("name").alias("workspace"), F.col("root").alias("_root"))
    asked = files.select("path", F.explode(folders).alias("_root")).join(w, "_root")
    owner = asked.groupBy("path").agg(F.max_by("workspace", F.length("_root")).alias("workspace"))
    return files.join(owner, "path", "left")
