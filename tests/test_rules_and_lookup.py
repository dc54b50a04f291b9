"""The rule engine against a plain version, structural rules on examples, and look-ups on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import code, journal, lookup, rules
from quillspark.sources import extract

BY_NAME = {r.name: r for r in rules.CATALOGUE + rules.SECRETS}

#: Texts that a rule has to find, and texts that it has to leave.
EXAMPLES = [
    ("empty-catch", "try { a() } catch (e) {\n  // nothing\n}", True),
    ("empty-catch", "try { a() } catch { /* nothing */ }", True),
    ("empty-catch", "try { a() } catch (e) { log(e) }", False),
    ("await-in-loop", "for (const x of xs) {\n  await go(x)\n}", True),
    ("await-in-loop", "for (const x of xs) {\n  use(x)\n}\nawait done()", False),
    ("await-in-loop", "async def f():\n    for x in xs:\n        await go(x)\n", True),
    ("await-in-loop", "async def f():\n    for x in xs:\n        go(x)\n    await done()\n", False),
    ("n-plus-one", "users.forEach((u) => {\n  if (u) {\n    db.findOne(u.id)\n  }\n})", True),
    ("n-plus-one", "db.findOne(1)", False),
    ("expensive-recompute", "while (true) {\n  const v = JSON.parse(s)\n}", True),
    ("unbounded-findmany", "await db.user.findMany({\n", True),
    ("unbounded-findmany", "await db.user.findMany({ take: 10 })", False),
    ("unsafe-raw-sql", "const q = `select * from t where id = ${id}`", True),
    ("debug-enabled", "DEBUG = True", True),
    ("debug-enabled", "# DEBUG = True", False),
    ("missing-csrf-middleware", "MIDDLEWARE = [\n  'x',\n]", True),
    ("missing-csrf-middleware", "MIDDLEWARE = [\n  'django.middleware.csrf.CsrfViewMiddleware',\n]", False),
    ("each-removed", "while (list($k) = each($a)) {", True),
    ("nest-missing-guard-method", "class G implements CanActivate {\n}", True),
    ("nest-missing-guard-method", "class G implements CanActivate {\n  canActivate() {}\n}", False),
    ("hono-missing-error-handler", "const app = new Hono()", True),
    ("astro-missing-lang-attr", "<html>", True),
    ("astro-missing-lang-attr", '<html lang="en">', False),
    ("compose-missing-remember", "val a = mutableStateOf(0)", True),
    ("compose-missing-remember", "val a = remember { mutableStateOf(0) }", False),
    ("button-no-type", "<button>", True),
    ("console-log", "a() // console.log(1)", False),
    ("scaffolding", "// TODO later", True),
    ("private-key", "-----BEGIN RSA PRIVATE KEY-----", True),
]


def test_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(EXAMPLES)] + [(99, None)], "id long, text string")
    got = {(r.id, r.rule) for r in rules.scan(df, "id", "text", rules.CATALOGUE + rules.SECRETS).collect()}
    for i, (name, text, found) in enumerate(EXAMPLES):
        assert ((i, name) in got) == found, (name, text)
    assert not any(i == 99 for i, _ in got)


def plain_scan(text, chosen):
    """The rules of lines and files, line by line with Python's own patterns."""
    out = set()
    lines = [(n, line, re.sub(r"^\s*(#|\*).*$", "", re.sub(r"(^|[^:])//.*$", r"\1", line))) for n, line in enumerate(text.split("\n"), 1)]
    for r in chosen:
        hits = [n for n, line, bare in lines if re.search(r.pattern, bare if r.code else line, re.ASCII)]
        if r.scope == "file":
            if hits and not (r.unless and any(re.search(r.unless, bare, re.ASCII) for _, _, bare in lines)):
                out.add((r.name, hits[0]))
        else:
            out |= {(r.name, n) for n in hits if not (r.unless and re.search(r.unless, lines[n - 1][2] if r.code else lines[n - 1][1], re.ASCII))}
    return out


def test_scan_matches_a_plain_version(spark):
    chosen = [r for r in rules.CATALOGUE + rules.SECRETS if r.scope in ("line", "file")]
    texts = {i: t for i, (_, t, _) in enumerate(EXAMPLES)} | {200: "\n".join(t for _, t, _ in EXAMPLES), 201: "", 202: "x = 1"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {}
    for r in rules.scan(df, "id", "text", chosen).collect():
        got.setdefault(r.id, set()).add((r.rule, r.line_no))
    for i, t in texts.items():
        assert got.get(i, set()) == plain_scan(t, chosen), t


@pytest.mark.parametrize("rule", rules.CATALOGUE + rules.SECRETS, ids=lambda r: f"{r.family}-{r.name}")
def test_needed_literals(rule):
    """Every example that matches holds one of the literals that the engine looks for first."""
    literals = rules.needed(rule.pattern)
    for _, t, _ in EXAMPLES:
        for line in t.split("\n"):
            if (m := re.search(rule.pattern, line)) and literals is not None:
                assert any(x in (m[0].lower() if re.compile(rule.pattern).flags & re.I else m[0]) for x in literals)


def test_audit(spark):
    df = spark.createDataFrame([(1, "eval(x)\neval(x)"), (2, "print(1)")], "id long, text string")
    found = rules.scan(df, "id", "text", [r for r in rules.CATALOGUE if r.family == "python"])
    (row,) = rules.audit(found.unionByName(found), df, "id").collect()
    assert (row.family, row.findings, row.files, row.score, row.grade) == ("python", 3, 2, 79, "B")


@pytest.fixture(scope="module")
def tables(spark):
    files = [
        ("pkg/a.py", "python", "import os\nfrom pkg.b import helper\n\nclass Base:\n    def run(self):\n        return helper()\n"),
        ("pkg/b.py", "python", "def helper():\n    return 1\n\ndef lonely():\n    return helper()\n"),
        ("web/c.ts", "typescript", "import { x } from './d'\nexport function go() {\n  return fetch(`https://h/api/${id}?q=1`, { method: 'POST' })\n}\n"),
        ("web/d.ts", "typescript", "export const x = 1\n"),
    ]
    f = spark.createDataFrame(files, "path string, language string, text string")
    return f, extract.extract(f).cache(), extract.imports(f)


def test_lookups(spark, tables):
    files, symbols, imports = tables
    names = {r.name: r for r in symbols.collect()}
    assert [r.name for r in lookup.get_symbols(symbols, [names["helper"].id, "none"]).collect()] == ["helper"]
    edges = code.call_edges(symbols)
    (shown,) = lookup.find_and_show(symbols, edges, "help", references=True).collect()
    assert shown.name == "helper" and shown.callers == 2
    assert lookup.detail(symbols, "compact").columns == lookup.DETAIL["compact"]
    outline = {(r.file, r.name): r.depth for r in lookup.file_outline(symbols, "pkg/a.py").collect()}
    assert outline == {("pkg/a.py", "Base"): 0, ("pkg/a.py", "run"): 1}
    folders = {r.folder: (r.files, r.symbols) for r in lookup.repo_outline(symbols, files).collect()}
    assert folders["pkg"] == (2, 4) and folders["web"][0] == 2
    uses = spark.createDataFrame([("pkg/a.py", "helper"), ("pkg/b.py", "lonely")], "file string, name string")
    found = {(r.file, r.name): (r.def_file, r.def_line, r.ambiguous) for r in lookup.go_to_definition(symbols, uses).collect()}
    assert found == {("pkg/a.py", "helper"): ("pkg/b.py", 1, False), ("pkg/b.py", "lonely"): ("pkg/b.py", 4, False)}
    near = {(r.direction, r.name) for r in lookup.call_hierarchy(symbols, edges, "helper").collect()}
    assert near == {("caller", "run"), ("caller", "lonely")}
    bundle = {(r.part, r.name) for r in lookup.context_bundle(symbols, imports, names["run"].id).collect()}
    assert ("symbol", "run") in bundle and ("sibling", "Base") in bundle and any(p == "import" for p, _ in bundle)
    changed = {(r.path, r.line_no): r.after for r in lookup.rename_preview(files, "helper", "aid").collect()}
    assert changed["pkg/b.py", 1] == "def aid():" and len(changed) == 4
    assert {r.path for r in lookup.centrality(imports, files).collect()} == {"web/d.ts"}
    chunks = {(r.path, r.start_line) for r in lookup.symbol_chunks(symbols, files).collect()}
    assert {("pkg/a.py", 1), ("pkg/a.py", 4), ("pkg/a.py", 5), ("pkg/b.py", 1)} <= chunks
    (call,) = lookup.outbound_calls(files.withColumn("repo", F.lit("r"))).collect()
    assert (call.method, call.url, call.line_no) == ("POST", "/api/{id}", 3)
    refs = lookup.cross_repo_references(files.withColumn("repo", F.lit("r")), "helper").collect()
    assert {(r.path, r.line_no) for r in refs} == {("pkg/a.py", 2), ("pkg/a.py", 6), ("pkg/b.py", 1), ("pkg/b.py", 5)}
    assert [r.name for r in lookup.cross_repo_symbols(symbols, "hel").collect()] == ["helper"]


def test_diffs_and_graphs(spark, tables):
    _, symbols, _ = tables
    after = symbols.where("name <> 'lonely'").withColumn("source", F.when(F.col("name") == "helper", "def helper(): return 2").otherwise(F.col("source")))
    assert {(r.change, r.name) for r in lookup.diff_outline(symbols, after).collect()} == {("removed", "lonely"), ("modified", "helper")}
    gone = lookup.removed_exports(symbols.withColumn("is_exported", F.lit(True)), after.withColumn("is_exported", F.lit(True))).collect()
    assert [(r.name, r.moved_to) for r in gone] == [("lonely", None)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in lookup.focus_subgraph(edges, "a", 2).collect()} == {("a", "b"), ("b", "c")}
    assert spark.range(1).select(lookup.canonical_cycle(F.array(F.lit("c"), F.lit("a"), F.lit("b")))).first()[0] == ["a", "b", "c"]
    columns = spark.createDataFrame([("users", "email", "varchar(9)"), ("users", "age", "int4"), ("logs", "mail_id", "BIGINT")], "table string, column string, type string")
    assert [(r.table, r.column) for r in lookup.search_columns(columns, name="MAIL", kind="int").collect()] == [("logs", "mail_id")]


def test_workspaces(spark):
    manifests = spark.createDataFrame([("a/package.json", "a", {"b": "*", "react": "1"}), ("b/package.json", "b", {"c": "*"}), ("c/package.json", "c", None)], "path string, name string, dependencies map<string,string>")
    w = lookup.workspaces_of(manifests)
    assert {(r.name, r.root, tuple(r.deps)) for r in w.collect()} == {("a", "a", ("b",)), ("b", "b", ("c",)), ("c", "c", ())}
    changed = spark.createDataFrame([("c",), (None,)], "workspace string")
    assert {tuple(r) for r in lookup.affected_workspaces(changed, w).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    files = spark.createDataFrame([("a/x.ts",), ("b/y.ts",), ("z.ts",)], "path string")
    assert {(r.path, r.workspace) for r in code.workspace_of(files, w).collect()} == {("a/x.ts", "a"), ("b/y.ts", "b"), ("z.ts", None)}
    crossing = spark.createDataFrame([("a/x.ts", "b/y.ts", "a", "b"), ("a/x.ts", "c/z.ts", "a", "c")], "src string, dst string, from_workspace string, to_workspace string")
    assert [(r.src, r.dst) for r in lookup.workspace_boundaries(crossing, w).collect()] == [("a/x.ts", "c/z.ts")]


def test_journal(spark, tmp_path):
    path = str(tmp_path / "notes")
    journal.append(spark, path, "repo", [("journal", "day", "first"), ("scratch", "a", "1"), ("scratch", "a", "2"), ("scratch", "b", "")])
    journal.plan(spark, path, "repo", "move", ["read", "write\twith a tab"])
    journal.set_status(spark, path, "repo", "move", 1, "completed")
    entries = journal.read(spark, path)
    assert {(r.key, r.body) for r in journal.scratch(entries, "repo").collect()} == {("a", "2"), ("b", "")}
    assert {(r.step, r.status, r.title) for r in journal.plan_steps(entries, "repo", "move").collect()} == {(1, "completed", "read"), (2, "pending", "write\twith a tab")}
    (p,) = journal.plans(entries).collect()
    assert (p.plan, p.steps, p.completed, p.status) == ("move", 2, 1, "in_progress")
    for bad in (lambda: journal.append(spark, path, "r", [("x", "k", "b")]), lambda: journal.set_status(spark, path, "repo", "move", 9, "failed"), lambda: journal.set_status(spark, path, "repo", "move", 1, "done")):
        with pytest.raises(ValueError):
            bad()


def test_rules_are_asked_only_behind_their_signs_and_literals(spark):
    """Every rule's literals are there in what it matches; most rules are asked only where a sign is."""
    import re

    scanned = [r for r in rules.CATALOGUE if r.scope in ("line", "file")]
    assert sum(rules.sign_of(r.pattern) is not None for r in scanned) > len(scanned) * 0.75
    assert rules.sign_of(r"^\s*print\s*\(") == "(" and rules.needed(r"^\s*print\s*\(", every=True) == [["print"], ["("]]
    text = "x = 1\nprint (x)\nprint x\nconsole.log(1) // TODO later\n# todo\nasync def f():\nDEBUG = True\nMIDDLEWARE = [\n 'a' ]"
    got = {(r.rule, r.line_no) for r in rules.scan(spark.createDataFrame([(1, text), (2, text + "\nawait CsrfViewMiddleware")], "k long, t string"), "k", "t", scanned).where("k = 1").collect()}
    bare = [re.sub(r"^\s*(#|\*).*$", "", re.sub(r"(^|[^:])//.*$", r"\1", x)) for x in text.split("\n")]
    want = set()
    for r in scanned:
        on = bare if r.code or r.scope == "file" else text.split("\n")
        hits = [i for i, x in enumerate(on, 1) if re.search(r.pattern, x)]
        if r.scope == "file":
            hits = hits[:1] if not (r.unless and any(re.search(r.unless, x) for x in bare)) else []
        else:
            hits = [i for i in hits if not (r.unless and re.search(r.unless, on[i - 1]))]
        want |= {(r.name, i) for i in hits}
    assert got == want and ("async-without-await", 6) in got
