"""Sources and extractors over small trees and logs; the code graph they feed; streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import code
from quillspark.sources import extract, files, logs
from quillspark.streaming import index as stream_index
from quillspark.streaming import usage as stream_usage

TREE = {
    "src/main.py": 'from src.util import helper\nimport os\n\nLIMIT = 3\n\n\nclass Base:\n    """Top."""\n\n    def run(self):\n        return helper()\n\n\ndef main():\n    return helper() + Base().run()\n',
    "src/util.py": "def helper():\n    return 1\n\n\ndef _private():\n    pass\n\n\ndef unused():\n    pass\n",
    "web/app.ts": "import { fetchUser, neverUsed } from './api';\nimport type { User } from './types';\nexport class App extends Shell implements Runs {\n  async start(x: number): Promise<void> {\n    fetchUser();\n  }\n}\nexport const MAX_SIZE = 10;\n",
    "web/api.ts": "export async function fetchUser() {\n  return 1;\n}\nexport interface Runs {\n}\n",
    "web/types.ts": "export type User = string;\n",
    "db/schema.sql": "-- users\nCREATE TABLE users (\n  id INT PRIMARY KEY,\n  total DECIMAL(10,2),\n  FOREIGN KEY (id) REFERENCES x(id)\n);\nCREATE VIEW v AS SELECT 1;\n",
    "README.md": "# Top\n\ntext\n\n## Part\n\n```\n# no\n```\n# Next\n",
    "node_modules/x/index.js": "function vendored() {}\n",
    "bad.py": "def (:\n",
    "pkg/package.json": json.dumps({"name": "pkg", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}),
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_scan(spark, tree):
    got = {r.path: r for r in files.scan(spark, tree).collect()}
    assert set(got) == set(TREE) - {"node_modules/x/index.js"}
    assert got["web/app.ts"].language == "typescript" and got["src/main.py"].text == TREE["src/main.py"]
    assert {(r.package, r.dependency, r.dev) for r in files.manifests(spark, tree).collect()} == {("pkg", "a", False), ("pkg", "b", True)}


def test_symbols_and_graph(spark, tree):
    f = files.scan(spark, tree)
    symbols = extract.extract(f)
    got = {(r.file, r.name, r.kind, r.parent) for r in symbols.collect()}
    assert {
        ("src/main.py", "LIMIT", "constant", None), ("src/main.py", "Base", "class", None), ("src/main.py", "run", "method", "Base"), ("src/util.py", "helper", "function", None),
        ("web/app.ts", "App", "class", None), ("web/app.ts", "start", "method", "App"), ("web/app.ts", "MAX_SIZE", "constant", None), ("web/api.ts", "fetchUser", "function", None),
        ("db/schema.sql", "users", "table", None), ("db/schema.sql", "id", "field", "users"), ("db/schema.sql", "total", "field", "users"), ("db/schema.sql", "v", "view", None),
        ("README.md", "Top", "section", None), ("README.md", "Part", "section", "Top"), ("README.md", "Next", "section", None),
    } <= got
    assert not [g for g in got if g[0] == "bad.py" or g[1] in {"FOREIGN", "no"}]
    names = {r.id: r.name for r in symbols.collect()}
    assert {(names[r.src], names[r.dst]) for r in code.call_edges(symbols).collect()} == {("run", "helper"), ("main", "helper"), ("start", "fetchUser")}
    edges = {(r.src, r.dst, r.type_only) for r in code.import_edges(extract.imports(f), f).collect()}
    assert edges == {("src/main.py", "src/util.py", False), ("web/app.ts", "web/api.ts", False), ("web/app.ts", "web/types.ts", True)}
    assert [(r.src, r.dst, r.kind) for r in code.heritage_edges(symbols).collect()] == [("web/app.ts", "web/api.ts", "implements")]
    dead = {r.name for r in code.dead_code(symbols, f).collect()}
    assert "unused" in dead and "helper" not in dead
    assert {(r.path, r.name) for r in code.unused_imports(f).collect()} == {("web/app.ts", "neverUsed"), ("web/app.ts", "User")}
    spaces = spark.createDataFrame([("root", ""), ("web", "web"), ("src", "src")], "name string, root string")
    assert {r.path: r.workspace for r in code.workspace_of(f.select("path"), spaces).collect()}["web/app.ts"] == "web"


def test_logs(spark, tmp_path):
    (tmp_path / "mac.jsonl").write_text('{"ts": 1, "tool": "a", "elapsed_ms": 2}\nbroken\n{"tool": "b"}\n{"ts": 2, "tool": "c", "host": "h"}\n')
    assert {(r.tool, r.host) for r in logs.usage(spark, str(tmp_path / "mac.jsonl")).collect()} == {("a", "mac"), ("c", "h")}
    row = ["2024-01-01", "s", "p", "x", "f", "m", "g", "3", "4", "5", "6", "b", "abc", "y", "n", "t", "r"]
    (tmp_path / "retro.log").write_text("RETRO: " + "\t".join(row) + "\nRETRO: short\tline\nother\n")
    (r,) = logs.retros(spark, str(tmp_path / "retro.log")).collect()
    assert (r.date, r.turns_wasted, r.files_modified, r.routing_status) == ("2024-01-01", 3, 6, "r")
    talk = [
        {"type": "user", "sessionId": "s", "timestamp": "1", "message": {"content": "question"}},
        {"type": "user", "sessionId": "s", "timestamp": "2", "message": {"content": [{"type": "tool_result", "content": "x"}]}},
        {"type": "assistant", "sessionId": "s", "timestamp": "3", "message": {"content": [{"type": "text", "text": "an"}, {"type": "text", "text": "swer"}]}},
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, talk)))
    assert [(r.question, r.answer) for r in logs.conversations(spark, str(tmp_path / "c.jsonl")).collect()] == [("question", "an\nswer")]
    (tmp_path / "log.txt").write_text("commit:abc\n\n1\t2\tsrc/a.py\n-\t-\timg.png\ncommit:def\n\n3\t0\tsrc/a.py\n")
    assert {tuple(r) for r in logs.git_numstat(spark, str(tmp_path / "log.txt")).collect()} == {("abc", "src/a.py", 1, 2), ("abc", "img.png", 0, 0), ("def", "src/a.py", 3, 0)}
    (tmp_path / "d.diff").write_text("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n+b\n")
    hunks = logs.diff_hunks(spark, str(tmp_path / "d.diff"))
    assert {tuple(r) for r in hunks.collect()} == {("x.py", 3, 6), ("x.py", 12, 12)}
    symbols = spark.createDataFrame([("x.py", "f", 1, 2), ("x.py", "g", 5, 9), ("y.py", "h", 3, 4)], "file string, name string, start_line int, end_line int")
    assert [r.name for r in logs.changed_symbols(symbols, hunks).collect()] == ["g"]


def test_refresh_plan(spark):
    schema = "path string, mtime_ms long, sha1 string, stale boolean"
    index = spark.createDataFrame([("same", 1, "a", False), ("touched", 1, "b", False), ("changed", 1, "c", False), ("stale", 1, "d", True), ("gone", 1, "e", False)], schema)
    now = spark.createDataFrame([("same", 1, "a"), ("touched", 2, "b"), ("changed", 2, "x"), ("stale", 1, "d"), ("new", 1, "n")], "path string, mtime_ms long, sha1 string")
    assert {r.path: r.action for r in stream_index.plan_refresh(now, index).collect()} == {"same": "keep", "touched": "touch", "changed": "parse", "stale": "parse", "gone": "drop", "new": "parse"}
    old = spark.createDataFrame([("lib.py", "f", "function", "f()"), ("x.py", "g", "function", "g()")], "file string, name string, kind string, signature string")
    new = spark.createDataFrame([("lib.py", "f", "function", "f(a)"), ("x.py", "g", "function", "g()")], "file string, name string, kind string, signature string")
    texts = spark.createDataFrame([("a.py", "import lib"), ("b.py", "libs"), ("lib.py", "lib")], "path string, text string")
    assert [r.path for r in stream_index.dirty_files(old, new, texts).collect()] == ["a.py"]


def test_streams(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    base.select("event_id", "ts", F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("tool"), F.col("value").alias("elapsed"), F.col("props").alias("args")).coalesce(1).write.parquet(source)
    static = spark.read.parquet(source)
    stream = spark.readStream.schema(static.schema).parquet(source)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    windows = run(stream_usage.windows(stream, late="40 days"), "win", "complete")
    want = static.groupBy(F.window("ts", "6 hours").alias("window"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("elapsed"), 2).alias("elapsed")).collect()
    assert {(r.window.start, r.tool, r.calls, r.elapsed) for r in windows} == {(r.window.start, r.tool, r.calls, r.elapsed) for r in want}
    hints = run(stream_usage.hints(stream), "hints", "append")
    per: dict = {}
    for r in sorted(static.collect(), key=lambda r: (r.ts, r.event_id)):
        per.setdefault(r.session, []).append(r)
    expect = set()
    for s, rows in per.items():
        runs = 0
        for i, r in enumerate(rows):
            runs = runs + 1 if i and rows[i - 1].tool == r.tool else 1
            if runs == 3:
                expect.add((s, r.event_id, "H2"))
            if i + 1 == 50:
                expect.add((s, r.event_id, "H10"))
            if r.args in [x.args for x in rows[:i]]:
                expect.add((s, r.event_id, "H5"))
    assert {tuple(h) for h in hints} == expect

    target = str(tmp_path / "table")
    q = stream.select(F.concat(F.lit("p"), F.col("event_id") % 50).alias("path"), "ts", "tool").writeStream.foreachBatch(stream_index.upsert(target)).option("checkpointLocation", str(tmp_path / "up")).trigger(availableNow=True).start()
    q.awaitTermination()
    table = {r.path: r.tool for r in stream_index.current(spark, target).collect()}
    newest = {}
    for r in sorted(static.collect(), key=lambda r: r.ts):
        newest[f"p{r.event_id % 50}"] = r.tool
    assert table == newest


def test_python_with_a_syntax_error_keeps_its_symbols():
    """One function without a body in its loop must not take the module's others away."""
    text = "def _part_1(size=45):\n    for row in query():\n    return 1\n\ndef ok(a):\n    x = (\n1\n    )\n    return x\n\nclass K(B):\n    def m(self):\n        return 1\n\n    def n(self:\n        return 2\n\nLIMIT = 3\nx = = 3\n"
    got = {s["name"]: (s["kind"], s["start_line"], s["end_line"], s.get("parent")) for s in extract.python(text)}
    assert got == {"_part_1": ("function", 1, 3, None), "ok": ("function", 5, 9, None), "K": ("class", 11, 16, None), "m": ("method", 12, 13, "K"), "n": ("method", 15, 16, "K"), "LIMIT": ("constant", 18, 18, None)}
    assert extract.python(text)[0]["source"] == text.split("\n\n")[0]


def test_code_queries_where_a_looping_part_calls_nothing(spark, tmp_path):
    import duckdb

    from quillspark.plans import ORACLE_SQL, QUERIES
    from verify import rows

    spark.range(60).select(F.col("id").alias("p_partkey"), F.lit(45).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, n, k) for o in range(40) for n, k in enumerate((o, (o * 7 + 1) % 40), 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("code_symbols", "code_call_edges", "code_file_outline", "code_repo_outline", "code_chunks"):
        df = QUERIES[name](spark, str(tmp_path))
        other = con.execute(ORACLE_SQL[name])
        assert rows(df.columns, df.collect()) == rows([d[0] for d in other.description], other.fetchall()), name


def test_extract_holds_few_symbols_at_a_time():
    """What a worker hands on at a time doesn't grow with the files that it is given."""
    import pandas as pd

    many = pd.DataFrame({"path": [f"m{i}.py" for i in range(400)], "language": "python", "text": "\n".join(f"def f{k}():\n    return {k}" for k in range(20))})
    got = list(extract._symbols(iter([many]), "local"))
    assert max(map(len, got)) <= 2000
    assert sum(map(len, got)) == 8000 and pd.concat(got)["id"].nunique() == 8000


def test_call_hierarchy_reads_each_text_once(spark):
    from quillspark.plans import code as plans

    df = plans.code_call_hierarchy(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
