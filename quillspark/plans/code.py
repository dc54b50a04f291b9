"""Queries over source text: every 20 parts are a Python module whose functions call the parts that follow them in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import lookup as L
from ..operators import rules as U
from ..operators.lineage import written
from ..sources import extract as X
from .base import table

MODULE = 20


def _edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    after = li.select("l_orderkey", (F.col("n") - 1).alias("n"), F.col("src").alias("dst"))
    return li.join(after, ["l_orderkey", "n"]).where("src <> dst").select("src", "dst").distinct()


def _path(part):
    return F.concat(F.lit("src/pkg"), F.pmod(F.floor(part / MODULE), F.lit(7)).cast("string"), F.lit("/mod"), F.floor(part / MODULE).cast("string"), F.lit(".py"))


def _files(spark, sf):
    """``(path, language, text)``; a part over size 40 has a loop, and of the odd ones the name is private."""
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    calls = _edges(spark, sf).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("calls"))
    name = lambda k: F.concat(F.when(k % 2 == 1, "_").otherwise(""), F.lit("part_"), k.cast("string"))
    body = F.transform(F.coalesce("calls", F.array().cast("array<bigint>")), lambda k: F.concat(F.when(F.col("p_size") > 40, "        ").otherwise("    "), name(k), F.lit("()")))
    loop = F.when(F.col("p_size") > 40, F.lit("\n    for row in query():")).otherwise("")
    text = F.concat(F.lit("def "), name(F.col("p_partkey")), F.lit("(size="), F.col("p_size").cast("string"), F.lit("):"), loop, F.lit("\n"), F.array_join(body, "\n"), F.when(F.size(body) > 0, "\n").otherwise(""), F.lit("    return 1"))
    one = part.join(calls, part["p_partkey"] == calls["src"], "left").select(_path(F.col("p_partkey")).alias("path"), "p_partkey", text.alias("text"))
    module = one.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return module.select("path", F.lit("python").alias("language"), "text")


def _symbols(spark, sf):
    return X.extract(_files(spark, sf))


def _called(spark, sf):
    """The symbols' columns that the call graph needs, as a table: it is read several times, the texts once."""
    return written(_symbols(spark, sf).select("id", "name", "kind", "file", "source"))


def _part_of(name):
    return F.regexp_extract(name, "[0-9]+", 0).cast("long")


def code_symbols(spark, sf):
    """Extraction: names, kinds and visibility."""
    return _symbols(spark, sf).select("file", "name", "kind", F.length("source").cast("long").alias("chars"))


def code_call_edges(spark, sf):
    """The call graph that is read from the text is the graph that it was written from."""
    s = _called(spark, sf)
    edges = C.call_edges(s)
    ids = s.select("id", "name")
    a, b = ids.select(F.col("id").alias("src"), _part_of(F.col("name")).alias("caller")), ids.select(F.col("id").alias("dst"), _part_of(F.col("name")).alias("callee"))
    return edges.join(a, "src").join(b, "dst").select("caller", "callee", "inferred")


def code_file_outline(spark, sf):
    return L.file_outline(_symbols(spark, sf)).groupBy("file").agg(F.count(F.lit(1)).alias("symbols"), F.max("depth").alias("deepest"), F.min("start_line").alias("first_line"))


def code_repo_outline(spark, sf):
    return L.repo_outline(_symbols(spark, sf), _files(spark, sf)).select("folder", "files", "symbols")


def code_call_hierarchy(spark, sf):
    s = _called(spark, sf)
    return L.call_hierarchy(s, C.call_edges(s), "part_10").select("direction", "name", "file")


def code_dead(spark, sf):
    """Functions whose name is a word of no other module. Modules of odd number stand alone here: the others' texts aren't given."""
    s = _symbols(spark, sf).withColumn("is_exported", F.lit(True))
    alone = _files(spark, sf).where(F.regexp_extract("path", "([0-9]+).py$", 1).cast("long") % 2 == 1)
    return C.dead_code(s, alone).select(_part_of(F.col("name")).alias("part"))


def code_nesting(spark, sf):
    """Lines in loop bodies, by module."""
    inside = _files(spark, sf).select("path", F.explode(U.loop_lines(F.col("text"))).alias("l"))
    return inside.where(F.trim("l.line").endswith("()")).groupBy("path").agg(F.count(F.lit(1)).alias("calls_in_loops"))


def code_chunks(spark, sf):
    return L.symbol_chunks(_symbols(spark, sf), _files(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def code_rename(spark, sf):
    """Where ``part_10`` would be renamed."""
    hits = L.rename_preview(_files(spark, sf), "part_10", "part_ten")
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("after") - F.length("before")).cast("long").alias("grown"))


def _columns(spark, sf):
    """Parts as columns of tables by brand, with declared types."""
    declared = F.element_at(F.array(*[F.lit(x) for x in ("INTEGER NOT NULL", "varchar(20)", "decimal(10,2)", "mediumblob", "timestamptz")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(F.concat(F.lit("t_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("table"), F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("column"), declared.alias("type"))


def column_search(spark, sf):
    return L.search_columns(_columns(spark, sf), name="COL_1", kind="numeric(3)", most=100)


def _workspaces(spark, sf):
    """Nations are workspaces that depend on the nations their customers buy from most."""
    n = table(spark, sf, "nation")
    deps = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", (F.col("s_suppkey") % 25).cast("int").alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("dep")), "k")
    lists = deps.where("n_name <> dep").groupBy("n_name").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    return n.join(lists, "n_name", "left").select(F.col("n_name").alias("name"), F.lower("n_name").alias("root"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))


def workspace_edges(spark, sf):
    return L.workspace_graph(_workspaces(spark, sf))


def workspace_affected(spark, sf):
    changed = table(spark, sf, "nation").where("n_nationkey = 3").select(F.col("n_name").alias("workspace"))
    return L.affected_workspaces(changed, _workspaces(spark, sf)).select("name", F.col("distance").cast("long").alias("distance"))


QUERIES = {f.__name__: f for f in [
    code_symbols, code_call_edges, code_file_outline, code_repo_outline, code_call_hierarchy, code_dead, code_nesting, code_chunks, code_rename, column_search, workspace_edges, workspace_affected,
]}

_NAME = "CASE WHEN {k} % 2 = 1 THEN '_' ELSE '' END || 'part_' || {k}"
_P = "'src/pkg' || ((p // 20) % 7) || '/mod' || (p // 20) || '.py'"
_E = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"
_S = f"""{_E}, c AS (SELECT src, count(*) AS n, sum(length({_NAME.format(k="dst")}) + 2) AS w FROM e GROUP BY src), s AS (SELECT p_partkey AS p, p_size, {_P.replace("p //", "p_partkey //")} AS file, {_NAME.format(k="p_partkey")} AS name, coalesce(n, 0) AS n,
    (4 + length({_NAME.format(k="p_partkey")}) + 6 + length(p_size::varchar) + 2 + CASE WHEN p_size > 40 THEN 24 ELSE 0 END + coalesce(w + n * (CASE WHEN p_size > 40 THEN 8 ELSE 4 END + 1), 0) + 13)::bigint AS chars, (2 + (p_size > 40)::int + coalesce(n, 0))::bigint AS lines FROM part LEFT JOIN c ON src = p_partkey)"""
_WS = "w AS (SELECT DISTINCT n.n_name AS src, d.n_name AS dst FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey JOIN nation d ON d.n_nationkey = s_suppkey % 25 WHERE n.n_name <> d.n_name)"

SQL = {
    "code_symbols": f"WITH {_S} SELECT file, name, 'function' AS kind, chars FROM s",
    "code_call_edges": f"WITH {_E} SELECT src AS caller, dst AS callee, false AS inferred FROM e",
    "code_file_outline": f"WITH {_S} SELECT file, count(*) AS symbols, 0::bigint AS deepest, 1 AS first_line FROM s GROUP BY file",
    "code_repo_outline": f"WITH {_S} SELECT regexp_replace(file, '/[^/]*$', '') AS folder, count(DISTINCT file) AS files, count(*) AS symbols FROM s GROUP BY 1",
    "code_call_hierarchy": f"WITH {_S}, x AS (SELECT 'caller' AS direction, src AS p FROM e WHERE dst = 10 UNION SELECT 'callee', dst FROM e WHERE src = 10) SELECT direction, name, file FROM x JOIN s USING (p)",
    "code_dead": f"WITH {_E}, m AS (SELECT dst AS p, src // 20 AS m FROM e UNION SELECT p_partkey, p_partkey // 20 FROM part) SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT p FROM m WHERE m % 2 = 1 GROUP BY p HAVING count(DISTINCT m) > 1)",
    "code_nesting": f"WITH {_S} SELECT file AS path, sum(n)::bigint AS calls_in_loops FROM s WHERE p_size > 40 AND n > 0 GROUP BY file",
    "code_chunks": f"WITH {_S} SELECT file AS path, count(*) AS chunks, sum(chars)::bigint AS chars FROM s GROUP BY file",
    "code_rename": f"WITH {_E}, h AS (SELECT {_P.replace('p //', 'src //')} AS path FROM e WHERE dst = 10 UNION ALL SELECT {_P.replace('p //', 'p_partkey //')} FROM part WHERE p_partkey = 10) SELECT path, count(*) AS lines, 1::bigint AS grown FROM h GROUP BY path",
    "column_search": """WITH c AS (SELECT 't_' || lower(replace(p_brand, '#', '_')) AS "table", 'col_' || p_partkey AS "column", (['INTEGER NOT NULL', 'varchar(20)', 'decimal(10,2)', 'mediumblob', 'timestamptz'])[(p_partkey % 5 + 1)::int] AS type, (['int', 'string', 'float', 'bytes', 'datetime'])[(p_partkey % 5 + 1)::int] AS family FROM part)
        SELECT * FROM c WHERE contains("column", 'col_1') AND family = 'float' ORDER BY "table", "column" LIMIT 100""",
    "workspace_edges": f"WITH {_WS} SELECT * FROM w",
    "workspace_affected": f"WITH RECURSIVE {_WS}, r AS (SELECT n_name AS name, 0::bigint AS distance FROM nation WHERE n_nationkey = 3 UNION SELECT src, distance + 1 FROM r JOIN w ON dst = name WHERE distance < 20) SELECT name, min(distance) AS distance FROM r GROUP BY name",
}
