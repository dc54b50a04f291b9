"""Analyses of framework projects over symbol, route and finding tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex
from .usage import half_up


def client_boundary_rank(components: DataFrame, k: int = 20) -> DataFrame:
    """Client components by lines + 20 imports - 30 dynamic imports + 15 third-party imports."""
    score = F.col("loc") + 20 * F.col("imports") - 30 * F.col("dynamic_imports") + 15 * F.col("third_party")
    return components.withColumn("score", score).orderBy(F.col("score").desc(), "file").limit(k)


def weighted_audit(dimensions: DataFrame) -> DataFrame:
    """One row ``(score, issues)`` over ``(dimension, score, weight)``: the weighed mean rounded, and how many are below 70."""
    return dimensions.agg(half_up(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).cast("long").alias("score"), F.count_if(F.col("score") < 70).alias("issues"))


def middleware_coverage(routes: DataFrame, matchers: list[str], admin: tuple[str, ...] = ("/admin", "/dashboard", "/settings", "/api/admin")) -> DataFrame:
    """``(route, protected, severity)``: routes that a matcher covers, and a high warning for open ones under an admin prefix."""
    covered, sensitive = F.lit(False), F.lit(False)
    for m in matchers:
        covered = covered | F.col("route").rlike(glob_to_regex(re.sub(r":\w+\*?", "**", m)))
    for a in admin:
        sensitive = sensitive | F.col("route").startswith(a)
    return routes.select("route", covered.alias("protected"), F.when(~covered & sensitive, "high").alias("severity"))


def middleware_chain(route: DataFrame, entries: DataFrame) -> DataFrame:
    """Middleware ``(scope, position, name, conditional)`` that runs for each route ``(method, path)``, in order. Entries are few."""
    scope = F.regexp_replace(F.regexp_replace("scope", r"/\*$", ""), r"^\*$", "")
    e = F.broadcast(entries.withColumn("prefix", scope))
    applies = (F.col("prefix") == "") | (F.col("path") == F.col("prefix")) | F.col("path").startswith(F.concat("prefix", F.lit("/")))
    return route.join(e, applies).withColumn("step", F.row_number().over(Window.partitionBy("method", "path").orderBy("position"))).select("method", "path", "step", "name", "conditional")


def expect_actual(declarations: DataFrame, platforms: list[str]) -> DataFrame:
    """Per expected ``(name, kind)``: the platforms without an actual declaration; orphan actuals have ``expected`` false."""
    wanted = F.array(*[F.lit(p) for p in platforms])
    per = declarations.groupBy("name", "kind").agg(F.max((F.col("modifier") == "expect").cast("int")).alias("e"), F.collect_set(F.when(F.col("modifier") == "actual", F.col("platform"))).alias("have"))
    return per.select("name", "kind", (F.col("e") == 1).alias("expected"), F.when(F.col("e") == 1, F.array_sort(F.array_except(wanted, "have"))).otherwise(F.array()).alias("missing"))


def compiler_readiness(findings: DataFrame, components: DataFrame, redundant: tuple[str, ...] = ("compiler-redundant-memo", "compiler-redundant-usecallback")) -> DataFrame:
    """One row ``(components, ready, blocked, redundant)``: a component is blocked by any finding that isn't a redundant memo."""
    per = findings.groupBy("component").agg(F.count_if(~F.col("rule").isin(*redundant)).alias("bail"), F.count_if(F.col("rule").isin(*redundant)).alias("memo"))
    both = components.select("component").distinct().join(per, "component", "left")
    return both.agg(F.count(F.lit(1)).alias("components"), F.count_if(F.coalesce("bail", F.lit(0)) == 0).alias("ready"), F.count_if(F.col("bail") > 0).alias("blocked"), F.coalesce(F.sum("memo"), F.lit(0)).alias("redundant"))


def n_plus_one(methods: DataFrame) -> DataFrame:
    """``(id, relation)``: relations read from a foreach variable's items unless loaded by ``with('relation')`` before, once each."""
    loops = methods.select("id", "source", F.explode(F.regexp_extract_all("source", F.lit(r"foreach\s*\([^)]*\bas\s+(?:\$\w+\s*=>\s*)?\$(\w+)\s*\)"), F.lit(1))).alias("item"))
    reads = loops.select("id", "source", "item", F.explode(F.regexp_extract_all("source", F.lit(r"\$(\w+->\w+)\s*(?:->|\[)"), F.lit(1))).alias("read"))
    mine = reads.where(F.col("read").startswith(F.concat("item", F.lit("->")))).withColumn("relation", F.element_at(F.split("read", "->"), -1))
    loaded = F.regexp_like("source", F.concat(F.lit("with\\s*\\(\\s*(\\[[^\\]]*)?['\"]"), F.col("relation"), F.lit("['\".]")))
    return mine.where(~loaded & ~F.col("relation").isin("id", "name", "title", "status", "created_at", "updated_at")).select("id", "relation").distinct()


def gate_summary(findings: DataFrame, gates: DataFrame) -> DataFrame:
    """Per gate ``(check, status)``: findings by severity; cycle errors count as high, warnings as medium."""
    level = F.when((F.col("check") == "circular") & (F.col("severity") == "error"), "high").when(F.col("severity") == "warning", "medium").when(F.col("check") == "anti-patterns", "medium").otherwise(F.col("severity"))
    per = findings.withColumn("level", level).groupBy("check").agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("critical", "high", "medium", "low")])
    return gates.join(per, "check", "left").fillna(0, ["critical", "high", "medium", "low"])


#: Prisma calls and the statements they stand for.
PRISMA = {
    "findMany": "SELECT * FROM {t}{w}{l}", "findFirst": "SELECT * FROM {t}{w} LIMIT 1", "findUnique": "SELECT * FROM {t}{w} LIMIT 1", "count": "SELECT COUNT(*) FROM {t}{w}",
    "create": "INSERT INTO {t} (...) VALUES (...)", "update": "UPDATE {t} SET ...{w}", "updateMany": "UPDATE {t} SET ...{w}", "delete": "DELETE FROM {t}{w}", "deleteMany": "DELETE FROM {t}{w}",
}


def explain_prisma(code: Column) -> Column:
    """Struct (sql, warning) of the first Prisma call in a text; null without one."""
    table, method = F.regexp_extract(code, r"prisma\.(\w+)\.(\w+)\s*\(", 1), F.regexp_extract(code, r"prisma\.(\w+)\.(\w+)\s*\(", 2)
    where = F.when(code.rlike(r"\bwhere\s*:"), " WHERE ...").otherwise("")
    take = F.regexp_extract(code, r"\btake\s*:\s*(\d+)", 1)
    sql = F.lit(None).cast("string")
    for name, form in PRISMA.items():
        built = F.lit(form)
        for mark, value in (("{t}", table), ("{w}", where), ("{l}", F.when(take != "", F.concat(F.lit(" LIMIT "), take)).otherwise(""))):
            built = F.replace(built, F.lit(mark), value)
        sql = F.when(method == name, built).otherwise(sql)
    warning = (
        F.when((method == "findMany") & (take == ""), "unbounded findMany").when(method.isin("deleteMany", "updateMany") & (where == ""), "touches every row")
        .when(F.regexp_extract(code, r"\bskip\s*:\s*(\d+)", 1).try_cast("long") > 1000, "large offset: page by cursor")
    )
    return F.when(sql.isNotNull(), F.struct(sql.alias("sql"), warning.alias("warning")))


def memory_confidence(score: Column) -> Column:
    return F.when(score > 5, "high").when(score > 2, "medium").otherwise("low")


def deduplicated_memories(memories: DataFrame) -> DataFrame:
    """Of memories ``(summary, score)`` that begin alike (60 characters, without case) the best."""
    w = Window.partitionBy(F.substring(F.lower("summary"), 1, 60)).orderBy(F.col("score").desc(), "summary")
    return memories.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("confidence", memory_confidence(F.col("score")))
