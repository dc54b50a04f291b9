"""Queries over texts: clones, rules, redaction, SQL text, web pages and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clones as C
from ..operators import rank as R
from ..operators import rules as U
from ..operators import sqltext as S
from ..operators import web as W
from .base import sql_lines, table

#: Rules of a line or a file, which SQL can express; the others follow loops or the squeezed text.
SCANNED = [r for r in U.CATALOGUE if r.scope in ("line", "file")]
STRUCTURAL = [r for r in U.CATALOGUE if r.scope in ("loop", "squeezed")]


def clones_exact(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.normalised_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return rows.groupBy(F.sha2(F.array_join("l", "\n"), 256).alias("bucket")).agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("members > 1").select("first", "last", "members")


def clones_near(spark, sf):
    return C.near(C.line_sets(table(spark, sf, "documents"), "doc_id", "text"))


def shape_clusters(spark, sf):
    return C.shape_clusters(table(spark, sf, "part"), "p_partkey", "p_name").select("members", "first")


def _texts(spark, sf):
    doc = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    return doc.unionByName(table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("html").alias("text")))


def pattern_scan(spark, sf):
    """All rules of lines and files over all texts."""
    return U.scan(_texts(spark, sf), "key", "text", SCANNED).select("key", "rule", "severity", "family", "line_no")


def pattern_counts(spark, sf):
    return pattern_scan(spark, sf).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"))


def structural_scan(spark, sf):
    """The rules that follow loops or look at the squeezed text, over a handler for each part: large parts wait in a loop, small ones swallow errors."""
    size = F.col("p_size")
    call = F.concat(F.lit("await part_"), F.col("p_partkey").cast("string"), F.lit("(JSON.parse(text))"))
    body = F.when(size > 40, F.concat(F.lit("for (const x of xs) {\n  "), call, F.lit("\n}"))).otherwise(call)
    text = F.concat(body, F.when(size < 5, "\ntry { go() } catch (e) {\n  // nothing\n}").otherwise(""))
    handlers = table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return U.scan(handlers, "p_partkey", "text", STRUCTURAL).select("p_partkey", "rule", "line_no")


def pattern_audit(spark, sf):
    """Scores of all families over all texts."""
    texts = _texts(spark, sf)
    return U.audit(U.scan(texts, "key", "text", SCANNED), texts, "key")


def secret_scan(spark, sf):
    return U.scan(table(spark, sf, "documents"), "doc_id", "text", U.SECRETS).select("doc_id", "rule", "severity", "line_no")


def pii_redaction(spark, sf):
    """Addresses and keys in the texts are masked; the digest of the result is compared."""
    masked = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"), r"(token|secret|key) = \"[A-Za-z0-9]+\"", r"$1 = \"[KEY]\"")
    return table(spark, sf, "documents").select("doc_id", F.length(masked).cast("long").alias("chars"), F.md5(masked).alias("digest"))


def _statements(spark, sf):
    """Orders as lines of SQL."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    where = F.when(k % 3 == 0, F.concat(F.lit(" WHERE o_orderkey = "), k)).otherwise("")
    body = (
        F.when(k % 5 == 0, F.concat(F.lit("DELETE FROM orders"), where)).when(k % 5 == 1, F.concat(F.lit("update orders set o_orderstatus = 'F'"), where))
        .when(k % 5 == 2, F.concat(F.lit("SELECT * FROM orders"), where)).when(k % 5 == 3, F.concat(F.lit("-- DROP TABLE t"), k % 7)).otherwise(F.concat(F.lit("ALTER TABLE customer "), F.element_at(F.array(*[F.lit(x) for x in ("ADD COLUMN a int", "DROP COLUMN b", "RENAME TO c", "ADD CONSTRAINT d", "ALTER COLUMN e TYPE int")]), (k % 25 / 5).cast("int") + 1)))
    )
    return o.select(k.alias("line_no"), body.alias("line"))


def dml_safety_lines(spark, sf):
    return _statements(spark, sf).withColumn("rule", S.dml_finding(F.col("line"))).where("rule is not null").select("line_no", "rule")


def migration_diff(spark, sf):
    ops = _statements(spark, sf).withColumn("op", S.migration_operation(F.col("line"))).where("op is not null")
    return ops.groupBy("op.operation", "op.category", "op.severity").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def table_references(spark, sf):
    return S.table_references(_statements(spark, sf), "line", ["orders", "customer", "lineitem"]).groupBy("table_name", "reference").agg(F.count(F.lit(1)).alias("n"))


def orphan_tables(spark, sf):
    """Tables that no statement names."""
    names = spark.createDataFrame([(n,) for n in ("orders", "customer", "lineitem", "audit_log")], "table_name string")
    used = S.table_references(_statements(spark, sf), "line", ["orders", "customer", "lineitem", "audit_log"]).select("table_name")
    return names.join(used, "table_name", "left_anti")


_TYPES = ["INT", "bigint(20)", "varchar(255)", "Decimal(10,2)", "TIMESTAMPTZ", "jsonb", "uuid", "bytea", "bool", "geometry(Point)", "", "double precision"]


def schema_type_normalize(spark, sf):
    typed = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("p_partkey") % len(_TYPES)).cast("int") + 1)
    return table(spark, sf, "part").select(typed.alias("declared")).groupBy("declared", T.sql_type(F.col("declared")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def _columns(df, tables: str, offset: int):
    """Parts as columns of tables."""
    k = F.col("p_partkey")
    typed = F.element_at(F.array(F.lit("int"), F.lit("string"), F.lit("float")), ((k + offset * (k % 10 == 0).cast("int")) % 3).cast("int") + 1)
    name = F.when(k % 17 == 0, "updated_at").otherwise(F.concat(F.lit("c"), k))
    return df.where((k + offset) % 8 != 0).select(F.concat(F.lit(tables), k % 20).alias("table_name"), name.alias("column_name"), typed.alias("type"), (k % 40 < 19).alias("is_primary")).dropDuplicates(["table_name", "column_name"])


def schema_drift(spark, sf):
    part = table(spark, sf, "part")
    return S.drift(_columns(part, "t", 0), _columns(part, "t", 1)).where("column_name <> 'updated_at'")


def sql_lint(spark, sf):
    k = F.col("p_partkey")
    cols = table(spark, sf, "part").select(F.concat(F.lit("t"), k % 83).alias("table_name"), F.col("p_name").alias("column_name"), (k % 3 == k % 83 % 4).alias("is_primary"))
    return S.lint(cols)


def schema_complexity(spark, sf):
    part = table(spark, sf, "part").select(F.concat(F.lit("t"), F.col("p_partkey") % 50).alias("table_name"), "p_partkey", "p_size")
    return S.schema_complexity(part, part.where("p_size > 40"), part.where("p_size < 5"))


def fk_index_coverage(spark, sf):
    part = table(spark, sf, "part").select(F.concat(F.lit("t"), F.col("p_partkey") % 50).alias("table_name"), F.col("p_partkey").alias("column_name"), "p_size")
    return S.index_coverage(part.where("p_size > 25"), part.where("p_size % 3 = 0"))


def contract_match(spark, sf):
    """Pages' addresses as calls, route templates as endpoints."""
    endpoints = spark.createDataFrame([("GET", ["fr", "{id}"], "fr-page"), ("GET", ["{lang}", "{id}"], "any-page"), ("POST", ["fr", "{id}"], "post-page"), ("GET", ["en", "*"], "en-all"), ("GET", ["de"], "de-home")], "method string, template array<string>, endpoint string")
    calls = table(spark, sf, "pages").select("page_id", F.lit("GET").alias("method"), W.segments(F.col("url")).alias("segments"))
    return W.contracts(endpoints, calls).select("page_id", "endpoint")


def link_integrity(spark, sf):
    """Links whose first segment is no page's language."""
    pages = table(spark, sf, "pages")
    known = pages.select(F.get(W.segments(F.col("url")), F.lit(0)).alias("seg")).where("seg is not null").distinct()
    links = pages.select("page_id", F.explode(W.hrefs(F.col("html"))).alias("href")).withColumn("seg", F.get(F.split(F.regexp_replace("href", "^/", ""), "/"), F.lit(0)))
    return links.join(known, "seg", "left_anti").groupBy("page_id").agg(F.count(F.lit(1)).alias("broken"), F.count_distinct("href").alias("different"))


def metadata_audit(spark, sf):
    scored = table(spark, sf, "pages").select("page_id", W.metadata_score(F.col("html")).cast("long").alias("score"))
    return scored.select("page_id", "score", W.grade(F.col("score")).alias("grade"))


def route_modules(spark, sf):
    """Routes by the first part of their path: pages, hosts and the lengths of their texts."""
    p = table(spark, sf, "pages").select(F.coalesce(F.get(W.segments(F.col("url")), F.lit(0)), F.lit("")).alias("module"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.length("html").alias("n"))
    return p.groupBy("module").agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("host").alias("hosts"), F.sum("n").alias("chars"))


def dead_routes(spark, sf):
    """Pages none of whose path segments occurs among the links."""
    pages = table(spark, sf, "pages")
    segs = pages.select("page_id", F.explode(W.segments(F.col("url"))).alias("seg"))
    linked = pages.select(F.explode(W.hrefs(F.col("html"))).alias("href")).select(F.regexp_replace("href", "^/", "").alias("seg")).distinct()
    live = segs.join(linked, "seg", "left_semi").select("page_id").distinct()
    return pages.select("page_id").join(live, "page_id", "left_anti")


def complexity_branches(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.branch_complexity(F.col("html")).cast("long").alias("complexity"))


def tag_depth(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.tag_depth(F.col("html")).cast("long").alias("depth"))


def incremental_upsert(spark, sf):
    """Documents as files, an older index of them: same time keeps, same hash keeps with the new time, else parse."""
    doc = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("sha"), (F.col("doc_id") * 10).alias("mtime"))
    old = doc.where("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("old_sha"), (F.col("mtime") - F.when(F.col("doc_id") % 3 == 0, 5).otherwise(0)).alias("old_mtime"))
    both = doc.join(old, "doc_id", "left")
    action = F.when(F.col("old_mtime").isNull(), "add").when(F.col("old_mtime") == F.col("mtime"), "keep").when(F.col("old_sha") == F.col("sha"), "touch").otherwise("parse")
    return both.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first"))


def dependency_freshness(spark, sf):
    """Parts as packages: sizes as installed majors against the brand's latest; the twenty furthest behind."""
    part = table(spark, sf, "part")
    latest = part.groupBy("p_brand").agg(F.max("p_size").alias("latest"))
    gap = part.join(latest, "p_brand").select("p_partkey", "p_brand", F.greatest(F.lit(0), F.col("latest") - F.col("p_size")).cast("long").alias("gap"))
    return R.top(gap, 20, "gap", "p_partkey")


def agent_config_audit(spark, sf):
    """Names in backticks that no index knows: part names as the instruction, brands as the index."""
    part = table(spark, sf, "part")
    words = part.select("p_partkey", F.explode(F.regexp_extract_all(F.concat(F.lit("use `"), F.col("p_name"), F.lit("` and `"), F.col("p_type"), F.lit("`")), F.lit("`([^`]+)`"), F.lit(1))).alias("name"))
    known = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name")).distinct()
    return words.join(known, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def test_confidence(spark, sf):
    """Tests for changed parts: 0.5, 0.3 more for a naming match, and the co-change share up to 0.2."""
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    part = table(spark, sf, "part")
    both = part.join(li, part["p_partkey"] == li["l_partkey"])
    score = F.least(F.lit(1.0), 0.5 + F.when(F.col("p_name").startswith("red"), 0.3).otherwise(0.0) + F.least(F.col("r") / F.col("n"), F.lit(0.2)))
    return both.select("p_partkey", R.rounded(score).alias("confidence"))


def god_models(spark, sf):
    """Suppliers as classes: over 600 methods, over 500 relations, or over 15500 lines."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("methods"), F.count_distinct("l_partkey").alias("relations"), F.sum("l_quantity").cast("long").alias("lines"))
    reasons = F.array_join(F.filter(F.array(F.when(F.col("methods") > 600, F.lit("methods")), F.when(F.col("relations") > 500, F.lit("relations")), F.when(F.col("lines") > 15500, F.lit("lines"))), lambda x: x.isNotNull()), ",")
    return li.withColumn("reasons", reasons).where("reasons <> ''")


def file_tree(spark, sf):
    """Directories to depth two with their symbol counts, from two files up."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat_ws("/", F.lit("src"), "n_name", "c_mktsegment", "c_name")
    tree = c.select(F.array_join(F.slice(F.split(path, "/"), 1, 3), "/").alias("dir"))
    w = Window.partitionBy("dir")
    return tree.withColumn("files", F.count(F.lit(1)).over(w)).distinct().where("files >= 2")


QUERIES = {f.__name__: f for f in [
    clones_exact, clones_near, shape_clusters, pattern_scan, pattern_counts, structural_scan, pattern_audit, secret_scan, pii_redaction, dml_safety_lines, migration_diff, table_references,
    orphan_tables, schema_type_normalize, schema_drift, sql_lint, schema_complexity, fk_index_coverage, contract_match, link_integrity, metadata_audit,
    route_modules, dead_routes, complexity_branches, tag_depth, incremental_upsert, dependency_freshness, agent_config_audit, test_confidence, god_models, file_tree,
]}

_NORM = f"list_filter(list_transform({sql_lines('text')}, lambda x: trim(regexp_replace(regexp_replace(x, '//.*$', ''), '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g'))), lambda x: x NOT IN ('', '{{', '}}', ');'))"
_STATEMENTS = """st AS (SELECT o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 0 THEN 'DELETE FROM orders' || w WHEN 1 THEN 'update orders set o_orderstatus = ''F''' || w WHEN 2 THEN 'SELECT * FROM orders' || w WHEN 3 THEN '-- DROP TABLE t' || (o_orderkey % 7)
    ELSE 'ALTER TABLE customer ' || (['ADD COLUMN a int', 'DROP COLUMN b', 'RENAME TO c', 'ADD CONSTRAINT d', 'ALTER COLUMN e TYPE int'])[(o_orderkey % 25 // 5)::int + 1] END AS line
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' WHERE o_orderkey = ' || o_orderkey ELSE '' END AS w FROM orders))"""
_SEG = r"list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s <> '')"
_HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_KEYED = "SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages"


def _quoted(p: str) -> str:
    return p.replace("'", "''").replace("(?m)^", "(?m)^")


def _scan_sql(source: str, key: str, rules) -> str:
    """Each rule over the lines of ``source``, an independent statement of what the engine finds."""
    head = rf"""WITH src AS ({source}), ln AS MATERIALIZED (SELECT {key}, line_no, line, regexp_replace(regexp_replace(line, '(^|[^:])//.*$', '\1'), '^\s*(#|\*).*$', '') AS bare
        FROM (SELECT {key}, unnest(l) AS line, unnest(generate_series(1, len(l)))::int AS line_no FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM src)))"""
    parts = []
    for r in rules:
        on = "bare" if r.code else "line"
        columns = f"{key}, '{r.name}' AS rule, '{r.severity}' AS severity, '{r.family}' AS family"
        match = f"regexp_matches({on}, '{_quoted(r.pattern)}')"
        if r.scope == "file":
            excused = f" AND {key} NOT IN (SELECT {key} FROM ln WHERE regexp_matches(bare, '{_quoted(r.unless)}'))" if r.unless else ""
            parts.append(f"SELECT {columns}, min(line_no) AS line_no FROM ln WHERE {match}{excused} GROUP BY {key}")
        else:
            unless = f" AND NOT regexp_matches({on}, '{_quoted(r.unless)}')" if r.unless else ""
            parts.append(f"SELECT {columns}, line_no FROM ln WHERE {match}{unless}")
    return head + " " + " UNION ALL ".join(parts)


def _audit_sql() -> str:
    cost = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in U._SEVERITY_COST.items()) + " END"
    score = "greatest(0, 100 - floor(cost * 100 / greatest(total, 100) + 0.5))::bigint"
    return f"""WITH f AS ({_scan_sql(_KEYED, 'key', SCANNED)}), p AS (SELECT family, count(*) AS findings, count(DISTINCT key) AS files, sum({cost}) AS cost FROM (SELECT DISTINCT key, family, rule, severity, line_no FROM f) GROUP BY family),
        t AS (SELECT count(*) AS total FROM ({_KEYED})), s AS (SELECT family, findings, files, {score} AS score FROM p, t)
        SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s"""



_OPS = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{op}'" for op, p, _, _ in S.MIGRATIONS)
_FAMILY = " ".join(f"WHEN w IN ({', '.join(repr(x) for x in ws)}) THEN '{f}'" for f, ws in T.SQL_TYPES.items())
_COLS = """SELECT DISTINCT 't' || (p_partkey % 20) AS table_name, 'c' || p_partkey AS column_name, (['int', 'string', 'float'])[((p_partkey + {o} * (p_partkey % 10 = 0)::int) % 3)::int + 1] AS type FROM part WHERE (p_partkey + {o}) % 8 <> 0 AND p_partkey % 17 <> 0"""
_BRANCH = " + ".join(f"len(regexp_extract_all(html, '{p}'))" for p in (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s", r"\bcatch\s*\(", r"\?[^.?:]", r"&&|\|\|"))

SQL = {
    "clones_exact": f"SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS members FROM (SELECT doc_id, array_to_string({_NORM}, chr(10)) AS l FROM documents) WHERE l <> '' GROUP BY l HAVING count(*) > 1",
    "clones_near": f"""WITH d AS (SELECT doc_id, {_NORM} AS l FROM documents), u AS (SELECT doc_id, len(l) AS total, list_sort(list_distinct(l)) AS ls FROM d WHERE len(l) > 0),
        s AS (SELECT min(doc_id) AS key, arg_min(total, doc_id) AS total, ls FROM u GROUP BY ls), x AS (SELECT key, total, len(ls) AS n, unnest(ls) AS line FROM s),
        p AS (SELECT a.key AS a, b.key AS b, count(*)::int AS shared, greatest(any_value(a.n), any_value(b.n)) AS most, any_value(a.total) AS ta, any_value(b.total) AS tb FROM x a JOIN x b ON a.line = b.line AND a.key < b.key GROUP BY 1, 2)
        SELECT a, b, floor(shared / most * 100 + 0.5) / 100 AS similarity, shared FROM p WHERE greatest(ta, tb) <= 1.3 * least(ta, tb) AND floor(shared / most * 100 + 0.5) / 100 >= 0.7 AND shared >= 3""",
    "shape_clusters": "SELECT count(*) AS members, min(p_partkey) AS first FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_name, '[A-Za-zÀ-ɏ]+', '_', 'g'), '[0-9]+', 'N', 'g'), '[ \\t\\n]+', ' ', 'g')) AS s FROM part) GROUP BY s HAVING count(*) > 1",
    "pattern_scan": _scan_sql(_KEYED, "key", SCANNED),
    "pattern_counts": f"SELECT rule, severity, count(*) AS findings FROM ({_scan_sql(_KEYED, 'key', SCANNED)}) GROUP BY 1, 2",
    "pattern_audit": _audit_sql(),
    "structural_scan": """SELECT p_partkey, unnest(['await-in-loop', 'expensive-recompute']) AS rule, 2 AS line_no FROM part WHERE p_size > 40
        UNION ALL SELECT p_partkey, 'empty-catch', NULL FROM part WHERE p_size < 5""",
    "secret_scan": f"SELECT doc_id, rule, severity, line_no FROM ({_scan_sql('SELECT doc_id, text FROM documents', 'doc_id', U.SECRETS)})",
    "pii_redaction": r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '(token|secret|key) = "[A-Za-z0-9]+"', '\1 = "[KEY]"', 'g') AS t FROM documents) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM m""",
    "dml_safety_lines": f"""WITH {_STATEMENTS}, r AS (SELECT line_no, CASE WHEN line ILIKE '%delete from%' AND NOT line ILIKE '% where %' THEN 'delete-without-where' WHEN regexp_matches(line, '(?i)update \\S+ set') AND NOT line ILIKE '% where %' THEN 'update-without-where' WHEN line ILIKE '%select *%' THEN 'select-star' END AS rule FROM st) SELECT * FROM r WHERE rule IS NOT NULL""",
    "migration_diff": f"""WITH {_STATEMENTS}, o AS (SELECT line_no, CASE {_OPS} END AS operation FROM st WHERE line NOT LIKE '--%'), i(operation, category, severity) AS (VALUES {', '.join(f"('{a}', '{c}', '{s}')" for a, _, c, s in S.MIGRATIONS)})
        SELECT operation, category, severity, count(*) AS n, min(line_no) AS first_line FROM o JOIN i USING (operation) GROUP BY ALL""",
    "table_references": f"""WITH {_STATEMENTS}, t(table_name) AS (VALUES ('orders'), ('customer'), ('lineitem')) SELECT table_name, CASE WHEN regexp_matches(line, '(?i)(alter|drop|create) table') THEN 'ddl' ELSE 'dml' END AS reference, count(*) AS n FROM st, t WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || table_name || '([^A-Za-z0-9_]|$)') GROUP BY 1, 2""",
    "orphan_tables": f"WITH {_STATEMENTS}, t(table_name) AS (VALUES ('orders'), ('customer'), ('lineitem'), ('audit_log')) SELECT table_name FROM t WHERE NOT EXISTS (SELECT 1 FROM st WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || table_name || '([^A-Za-z0-9_]|$)'))",
    "schema_type_normalize": f"WITH d AS (SELECT ({_TYPES!r})[(p_partkey % {len(_TYPES)})::int + 1] AS declared FROM part), w AS (SELECT declared, lower(regexp_extract(declared, '[a-zA-Z]+')) AS w FROM d) SELECT declared, CASE WHEN w = '' THEN 'unknown' {_FAMILY} ELSE w END AS family, count(*) AS n FROM w GROUP BY 1, 2",
    "schema_drift": f"WITH a AS ({_COLS.format(o=0)}), b AS ({_COLS.format(o=1)}) SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name, CASE WHEN b.type IS NULL THEN 'extra_in_orm' WHEN a.type IS NULL THEN 'extra_in_sql' ELSE 'type_mismatch' END AS drift FROM a FULL JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name WHERE a.type IS DISTINCT FROM b.type",
    "sql_lint": "WITH t AS (SELECT 't' || (p_partkey % 83) AS table_name, count(*) AS n, max((p_partkey % 3 = p_partkey % 83 % 4)::int) AS pk FROM part GROUP BY 1) SELECT table_name, 'no-primary-key' AS rule FROM t WHERE pk = 0 UNION ALL SELECT table_name, 'wide-table' FROM t WHERE n > 20",
    "schema_complexity": "SELECT 't' || (p_partkey % 50) AS table_name, count(*) + 3 * count(*) FILTER (p_size > 40) + 1.5::double * count(*) FILTER (p_size < 5) AS score FROM part GROUP BY 1",
    "fk_index_coverage": "SELECT floor(100 * count(*) FILTER (p_size % 3 = 0) / count(*) * 10 + 0.5) / 10 AS coverage FROM part WHERE p_size > 25",
    "contract_match": f"""WITH c AS (SELECT page_id, {_SEG} AS s FROM pages) SELECT page_id, 'fr-page' AS endpoint FROM c WHERE len(s) = 2 AND s[1] = 'fr' UNION ALL SELECT page_id, 'any-page' FROM c WHERE len(s) = 2
        UNION ALL SELECT page_id, 'en-all' FROM c WHERE len(s) >= 1 AND s[1] = 'en' UNION ALL SELECT page_id, 'de-home' FROM c WHERE len(s) = 1 AND s[1] = 'de'""",
    "link_integrity": f"WITH k AS (SELECT DISTINCT ({_SEG})[1] AS seg FROM pages WHERE len({_SEG}) > 0), l AS (SELECT page_id, unnest({_HREF}) AS href FROM pages) SELECT page_id, count(*) AS broken, count(DISTINCT href) AS different FROM l WHERE string_split(regexp_replace(href, '^/', ''), '/')[1] NOT IN (SELECT seg FROM k) GROUP BY 1",
    "metadata_audit": r"""WITH s AS (SELECT page_id, (CASE WHEN length(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)) >= 10 THEN 25 ELSE 0 END + CASE WHEN length(regexp_extract(html, '(?i)<meta name="description" content="([^"]*)"', 1)) >= 50 THEN 20 ELSE 0 END
        + CASE WHEN html ILIKE '%property="og:image"%' AND NOT html ILIKE '%placeholder%' THEN 20 ELSE 0 END + CASE WHEN html ILIKE '%rel="canonical"%' THEN 15 ELSE 0 END + CASE WHEN html ILIKE '%name="twitter:%' THEN 10 ELSE 0 END + CASE WHEN html ILIKE '%application/ld+json%' THEN 10 ELSE 0 END)::bigint AS score FROM pages)
        SELECT page_id, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'needs_work' ELSE 'poor' END AS grade FROM s""",
    "route_modules": f"SELECT coalesce(({_SEG})[1], '') AS module, count(*) AS routes, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS hosts, sum(length(html))::bigint AS chars FROM pages GROUP BY 1",
    "dead_routes": f"WITH s AS (SELECT page_id, unnest({_SEG}) AS seg FROM pages), l AS (SELECT DISTINCT regexp_replace(h, '^/', '') AS seg FROM (SELECT unnest({_HREF}) AS h FROM pages)) SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM s JOIN l USING (seg))",
    "complexity_branches": f"SELECT page_id, (1 + {_BRANCH})::bigint AS complexity FROM pages",
    "incremental_upsert": "SELECT CASE WHEN doc_id % 9 = 0 THEN 'add' WHEN doc_id % 3 <> 0 THEN 'keep' WHEN doc_id % 4 <> 0 THEN 'touch' ELSE 'parse' END AS action, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY 1",
    "dependency_freshness": "SELECT p_partkey, p_brand, (max(p_size) OVER (PARTITION BY p_brand) - p_size)::bigint AS gap FROM part ORDER BY gap DESC, p_partkey LIMIT 20",
    "agent_config_audit": "WITH w AS (SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part) SELECT name, count(*) AS n FROM w WHERE name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY 1",
    "test_confidence": "WITH l AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT p_partkey, round(least(1.0::double, 0.5 + CASE WHEN p_name LIKE 'red%' THEN 0.3 ELSE 0 END + least(r / n, 0.2::double)), 6) AS confidence FROM part JOIN l ON l_partkey = p_partkey",
    "god_models": "WITH l AS (SELECT l_suppkey, count(*) AS methods, count(DISTINCT l_partkey) AS relations, sum(l_quantity)::bigint AS lines FROM lineitem GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN methods > 600 THEN 'methods' END, CASE WHEN relations > 500 THEN 'relations' END, CASE WHEN lines > 15500 THEN 'lines' END) AS reasons FROM l WHERE methods > 600 OR relations > 500 OR lines > 15500",
    "file_tree": "SELECT 'src/' || n_name || '/' || c_mktsegment AS dir, count(*) AS files FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) >= 2",
}
