"""Look-ups over symbol, import and file tables: symbols, outlines, definitions, bundles, columns, workspaces, repositories.

Tables are those of ``schemas.py``. All are filters, equi joins, aggregates and top-k; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sql_type
from .graph import distinct_edges
from .lineage import written

#: The columns of a symbol at each level of detail, and the characters of source kept.
DETAIL = {"compact": ["id", "name", "kind", "file", "start_line"], "standard": ["id", "name", "kind", "file", "start_line", "end_line", "signature", "docstring"]}
SOURCE_CHARS = {"listed": 200, "in_file": 500, "most": 5000}


def detail(symbols: DataFrame, level: str = "standard") -> DataFrame:
    """The columns of a level: ``compact``, ``standard`` (no source) or ``full``."""
    return symbols if level == "full" else symbols.select(DETAIL[level])


def truncated(source: Column, chars: int) -> Column:
    """The source's first characters, with an ellipsis if something is cut."""
    return F.when(F.length(source) > chars, F.concat(F.substring(source, 1, chars), F.lit("..."))).otherwise(source)


def get_symbols(symbols: DataFrame, ids: list[str]) -> DataFrame:
    """The symbols with these ids; ids that are unknown give no row."""
    return symbols.where(F.col("id").isin(list(dict.fromkeys(ids))))


def find_and_show(symbols: DataFrame, edges: DataFrame, name: str, references: bool = False) -> DataFrame:
    """The symbol that a name means (exact before prefix before part, exported first, then file and line), with ``callers`` if asked."""
    low = F.lower("name")
    match = F.when(F.col("name") == name, 0).when(low == name.lower(), 1).when(low.startswith(name.lower()), 2).when(F.contains(low, F.lit(name.lower())), 3)
    best = symbols.withColumn("match", match).where("match is not null").orderBy("match", (~F.coalesce("is_exported", F.lit(False))).cast("int"), "file", "start_line").limit(1)
    if not references:
        return best.drop("match")
    callers = edges.groupBy("dst").agg(F.count_distinct("src").alias("callers"))
    return best.drop("match").join(callers, best["id"] == callers["dst"], "left").drop("dst").withColumn("callers", F.coalesce("callers", F.lit(0)))


def file_outline(symbols: DataFrame, path: str | None = None) -> DataFrame:
    """Per file its symbols in line order with their nesting depth: parents are symbols of the file whose lines contain them."""
    s = symbols if path is None else symbols.where(F.col("file") == path)
    a, b = s.select("file", "name", "kind", "start_line", "end_line").alias("a"), s.select("file", "start_line", "end_line").alias("b")
    outer = (F.col("b.start_line") <= F.col("a.start_line")) & (F.col("b.end_line") >= F.col("a.end_line")) & ((F.col("b.start_line") < F.col("a.start_line")) | (F.col("b.end_line") > F.col("a.end_line")))
    held = a.join(b, (F.col("a.file") == F.col("b.file")) & outer, "left")
    return held.groupBy("a.file", "a.name", "a.kind", "a.start_line", "a.end_line").agg(F.count("b.file").alias("depth"))


def repo_outline(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Per folder: files, symbols and exported symbols."""
    folder = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"/?[^/]*$", ""), F.lit("")), F.lit("."))
    of_files = files.groupBy(folder("path").alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    of_symbols = symbols.groupBy(folder("file").alias("folder")).agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.coalesce("is_exported", F.lit(False))).alias("exported"))
    return of_files.join(of_symbols, "folder", "left").na.fill(0, ["symbols", "exported"])


def go_to_definition(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses (file, name)`` with the definition: in the same file first, then the one exported elsewhere; several leave ``ambiguous``."""
    d = symbols.where("kind not in ('test_case', 'test_suite', 'field', 'section')").select("name", F.col("file").alias("def_file"), "start_line", F.coalesce("is_exported", F.lit(False)).alias("open"))
    met = uses.join(d, "name").withColumn("rank", F.when(F.col("file") == F.col("def_file"), 0).when(F.col("open"), 1).otherwise(2))
    best = met.groupBy("file", "name").agg(F.min(F.struct("rank", "def_file", "start_line")).alias("b"), F.sort_array(F.collect_list("rank")).alias("r"))
    return best.select("file", "name", F.col("b.def_file").alias("def_file"), F.col("b.start_line").alias("def_line"), F.coalesce(F.get("r", F.lit(1)) == F.get("r", F.lit(0)), F.lit(False)).alias("ambiguous"))


def call_hierarchy(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``(direction, id, name, file)`` of the direct callers and callees of the symbols with that name."""
    own = symbols.where(F.col("name") == name).select("id").distinct()
    other = symbols.select("id", "name", "file")
    # both directions in one reading of the edges
    met = edges.join(own.select(F.col("id").alias("_to")), F.col("dst") == F.col("_to"), "left").join(own.select(F.col("id").alias("_from")), F.col("src") == F.col("_from"), "left")
    ends = F.array(
        F.when(F.col("_to").isNotNull(), F.struct(F.lit("caller").alias("direction"), F.col("src").alias("id"))),
        F.when(F.col("_from").isNotNull(), F.struct(F.lit("callee").alias("direction"), F.col("dst").alias("id"))),
    )
    return met.select(F.explode(F.array_compact(ends)).alias("e")).select("e.*").distinct().join(other, "id").select("direction", "id", "name", "file")


def context_bundle(symbols: DataFrame, imports: DataFrame, symbol_id: str) -> DataFrame:
    """``(part, name, text)``: the symbol, its file's imports, its siblings' signatures and the types that its signature names."""
    me = symbols.where(F.col("id") == symbol_id)
    home = me.select(F.col("file").alias("home"), F.concat_ws(" ", "signature", "source").alias("words"))
    near = symbols.join(home, F.col("file") == F.col("home")).where(F.col("id") != symbol_id)
    types = symbols.where("kind in ('class', 'interface', 'type', 'enum')").crossJoin(F.broadcast(home)).where(F.array_contains(F.split("words", r"[^A-Za-z0-9_$]+"), F.col("name")) & (F.col("id") != symbol_id))
    parts = [
        me.select(F.lit("symbol").alias("part"), "name", F.coalesce("source", "signature").alias("text")),
        imports.join(home, F.col("file") == F.col("home")).select(F.lit("import").alias("part"), F.col("target").alias("name"), F.col("target").alias("text")),
        near.select(F.lit("sibling").alias("part"), "name", F.coalesce("signature", "name").alias("text")),
        types.select(F.lit("type").alias("part"), "name", F.coalesce("signature", "name").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def rename_preview(files: DataFrame, old: str, new: str) -> DataFrame:
    """``(path, line_no, before, after)`` of the lines where the identifier stands as a whole word."""
    pattern = rf"(^|[^A-Za-z0-9_$]){old}(?![A-Za-z0-9_$])"
    lines = files.where(F.contains("text", F.lit(old))).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "before"))
    return lines.where(F.col("before").rlike(pattern)).select("path", (F.col("pos") + 1).alias("line_no"), "before", F.regexp_replace("before", pattern, rf"$1{new}").alias("after"))


def diff_outline(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(change, file, name, kind)``: symbols added, removed or modified (other source) between two symbol tables."""
    key = ["file", "name", "kind"]
    a = before.groupBy(*key).agg(F.sort_array(F.collect_list(F.coalesce("source", "signature"))).alias("old"))
    b = after.groupBy(*key).agg(F.sort_array(F.collect_list(F.coalesce("source", "signature"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select("change", *key)


def removed_exports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Exported names of a file that it no longer exports, and whether another file does now (moved)."""
    was = before.where("is_exported").select("file", "name").distinct()
    now = after.where("is_exported").select("file", "name").distinct()
    gone = was.join(now, ["file", "name"], "left_anti")
    moved = now.groupBy("name").agg(F.min("file").alias("moved_to"))
    return gone.join(moved, "name", "left").select("file", "name", "moved_to")


def search_columns(columns: DataFrame, name: str | None = None, kind: str | None = None, table_name: str | None = None, most: int = 100) -> DataFrame:
    """``(table, column, type, family)`` by part of the column's and the table's name and by the type's family."""
    c = columns.select("table", "column", "type", sql_type(F.col("type")).alias("family"))
    if name:
        c = c.where(F.contains(F.lower("column"), F.lit(name.lower())))
    if table_name:
        c = c.where(F.contains(F.lower("table"), F.lit(table_name.lower())))
    if kind:
        c = c.where(F.col("family") == sql_type(F.lit(kind)))
    return c.orderBy("table", "column").limit(most)


def centrality(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, centrality)``: log2(1 + relative imports that name the file), an import's text meaning the first path that holds it."""
    part = F.regexp_replace("target", r"^(\.{1,2}/)+", "")
    asked = imports.where(F.col("target").rlike(r"^\.{1,2}/")).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).where("part <> ''")
    # a path holds the text at a folder border or in its file name: every tail of the path, with and without extension
    pieces = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    named = files.select("path", F.explode(F.array_distinct(F.concat(tails, F.transform(tails, lambda t: F.regexp_replace(t, r"\.[^./]+$", ""))))).alias("part"))
    first = named.groupBy("part").agg(F.min("path").alias("path"))
    return asked.join(first, "part").groupBy("path").agg(F.log2(F.sum("n") + 1).alias("centrality"))


def symbol_chunks(symbols: DataFrame, files: DataFrame, largest: int = 50_000) -> DataFrame:
    """``(path, start_line, end_line, text)``: the lines before the first symbol, and one chunk a symbol; nested ones overlap. Chunks over ``largest`` characters are cut."""
    lines = files.select("path", F.split("text", "\n").alias("lines"))
    spans = symbols.select(F.col("file").alias("path"), "start_line", "end_line").distinct()
    first = spans.groupBy("path").agg(F.min("start_line").alias("least")).where("least > 1").select("path", F.lit(1).alias("start_line"), (F.col("least") - 1).alias("end_line"))
    chunk = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return spans.unionByName(first).join(lines, "path").select("path", "start_line", "end_line", F.substring(chunk, 1, largest).alias("text")).where(F.trim("text") != "")


def focus_subgraph(edges: DataFrame, focus: str, depth: int = 2) -> DataFrame:
    """The edges among files within ``depth`` steps, either way, of those whose path holds ``focus``."""
    e = distinct_edges(edges)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = both.select(F.col("src").alias("node")).where(F.contains("node", F.lit(focus))).distinct()
    for _ in range(depth):
        seen = seen.unionByName(both.join(seen, both["src"] == seen["node"]).select(F.col("dst").alias("node"))).distinct()
    return e.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def canonical_cycle(path: Column) -> Column:
    """A cycle's nodes, turned so that the least comes first."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, at, F.size(path) - at + 1), F.slice(path, F.lit(1), at - 1))


# Workspaces: (name, root, deps array<string>)


def workspaces_of(manifests: DataFrame) -> DataFrame:
    """``(name, root, deps)`` from manifests ``(path, name, dependencies map)``: the folder is the root, deps are names of other workspaces."""
    w = manifests.where("name is not null").select("name", F.regexp_replace("path", r"/?[^/]*$", "").alias("root"), F.map_keys(F.coalesce("dependencies", F.create_map().cast("map<string,string>"))).alias("asked"))
    known = w.select(F.col("name").alias("dep"))
    held = w.select("name", F.explode("asked").alias("dep")).join(known, "dep").groupBy("name").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    return w.join(held, "name", "left").select("name", "root", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))


def workspace_graph(workspaces: DataFrame) -> DataFrame:
    """``(src, dst)`` edges from a workspace to those it depends on."""
    return workspaces.select(F.col("name").alias("src"), F.explode("deps").alias("dst")).where("src <> dst").distinct()


def affected_workspaces(changed: DataFrame, workspaces: DataFrame, depth: int = 20) -> DataFrame:
    """``(name, distance)``: workspaces of changed ``(workspace)`` rows, and those that depend on them, at their least distance."""
    e = workspace_graph(workspaces)
    seen = changed.where("workspace is not null").select(F.col("workspace").alias("name")).distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        found = e.join(frontier, e["dst"] == frontier["name"]).select(F.col("src").alias("name")).distinct().join(seen.select("name"), "name", "left_anti")
        frontier = written(found.withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def workspace_boundaries(file_edges: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``(src, dst, from_workspace, to_workspace)``: imports into a workspace that the importer's doesn't declare. ``file_edges`` carry both workspaces."""
    declared = workspace_graph(workspaces).select(F.col("src").alias("from_workspace"), F.col("dst").alias("to_workspace"))
    crossing = file_edges.where("from_workspace <> to_workspace").select("src", "dst", "from_workspace", "to_workspace").distinct()
    return crossing.join(declared, ["from_workspace", "to_workspace"], "left_anti").select("src", "dst", "from_workspace", "to_workspace")


# Several repositories


def cross_repo_symbols(symbols: DataFrame, query: str, repos: str = ".*", per_repo: int = 20) -> DataFrame:
    """Per repository whose name matches, the best symbols by name: exact, prefix, part; then file and line."""
    low = F.lower("name")
    match = F.when(low == query.lower(), 0).when(low.startswith(query.lower()), 1).when(F.contains(low, F.lit(query.lower())), 2)
    order = Window.partitionBy("repo").orderBy("match", "file", "start_line", "id")
    hits = symbols.where(F.col("repo").rlike(repos)).withColumn("match", match).where("match is not null")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_repo).select("repo", "name", "kind", "file", "start_line", "match", "rank")


def cross_repo_references(files: DataFrame, name: str) -> DataFrame:
    """``(repo, path, line_no)`` of the lines of ``files (repo, path, text)`` with the name as a whole word."""
    lines = files.where(F.contains("text", F.lit(name))).select("repo", "path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(rf"(^|[^A-Za-z0-9_]){name}([^A-Za-z0-9_]|$)")).select("repo", "path", (F.col("pos") + 1).alias("line_no"))


#: Calls of HTTP clients: the method is the function's name or an option.
_CLIENT = r"(?:axios|http|client|api|got|ky|requests|httpx)\.(get|post|put|patch|delete)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]|fetch\s*\(\s*[\"'`]([^\"'`]+)[\"'`](.{0,80})"


def outbound_calls(files: DataFrame) -> DataFrame:
    """``(repo, path, line_no, method, url)`` of HTTP calls with a literal address; ``${x}`` in it becomes ``{x}``, host and query go."""
    lines = files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(_CLIENT))
    verb = F.upper(F.regexp_extract("line", _CLIENT, 1))
    option = F.upper(F.regexp_extract("line", r"method\s*:\s*[\"'](\w+)[\"']", 1))
    url = F.concat(F.regexp_extract("line", _CLIENT, 2), F.regexp_extract("line", _CLIENT, 3))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"\$\{([^}]*)\}", r"{$1}"), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return lines.select("repo", "path", (F.col("pos") + 1).alias("line_no"), F.when(verb != "", verb).when(option != "", option).otherwise("GET").alias("method"), plain.alias("url"))
