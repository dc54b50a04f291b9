"""Operators on small literal cases."""

import random

from pyspark.sql import functions as F

from quillspark.functions import predicates as P
from quillspark.functions import text as T
from quillspark.operators import basket, clones, code, graph, rank, rules, sqltext, usage, web
from quillspark.plans import retrieval


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first()[0]


def test_tokens(spark):
    cases = {"getUserById": ["get", "user", "by", "id"], "Hello, World!": ["hello", "world"], "a b c": [], "": [], "XMLHttpRequest2": ["xml", "http", "request2"]}
    for text, want in cases.items():
        assert one(spark, T.tokenize(F.col("t")), t=text) == want == T.query_tokens(text)


def test_hashes_and_estimates(spark):
    assert one(spark, T.fnv1a32(F.col("t")), t="abc") == 440920331
    assert one(spark, T.djb2(F.col("t")), t="a") == 5381 * 33 + 97
    assert one(spark, T.token_estimate(F.col("t")), t="12345") == 2
    assert one(spark, T.normalised_lines(F.col("t")), t="  a  b // c\n}\n\n{\nx") == ["a b", "x"]
    assert one(spark, T.shape(F.col("t")), t="ab 12  cd") == "_ N _"


def test_globs(spark):
    path = F.lit("src/app/user.test.ts")
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(P.matches_path(path, "app/user")) and get(P.matches_path(path, "*.test.ts")) and get(P.matches_path(path, "src/**/*.ts"))
    assert not get(P.matches_path(path, "src/*.ts")) and not get(P.matches_path(path, "*.js"))
    assert get(P.matches_name(path, "user.*.{ts,js}")) and get(P.matches_name(path, "src")) and not get(P.matches_name(path, "lib"))
    assert get(P.is_test_file(path)) and get(P.is_test_file_strict(path)) and not get(P.is_noise(path)) and get(P.is_noise(F.lit("node_modules/x.js")))
    assert get(P.has_decorator(F.array(F.lit("@Get('/x')")), "Get")) and not get(P.has_decorator(F.array(F.lit("@Getter")), "Get"))


def test_sql_types_and_dialects(spark):
    for declared, family in {"INT": "int", "varchar(20)": "string", "Decimal(10,2)": "float", "timestamptz": "datetime", "geometry(x)": "geometry", "": "unknown"}.items():
        assert one(spark, T.sql_type(F.col("t")), t=declared) == family
    for text, name in {"id INT AUTO_INCREMENT": "mysql", "id SERIAL": "postgres", "id INTEGER PRIMARY KEY AUTOINCREMENT": "sqlite", "id INT IDENTITY(1,1)": "mssql", "select 1": "unknown"}.items():
        assert one(spark, T.dialect(F.col("t")), t=text) == name


def test_bm25_and_cutoff(spark):
    names = ["getUserById", "createUser", "deletePost", "userService", "validateEmail"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    best = rank.top(rank.bm25(df, "id", {"name": (F.col("name"), 5.0)}, "getUserById"), 5, "score", "id").collect()
    assert best[0].id == 0 and {r.id for r in best} == {0, 1, 3}
    assert rank.bm25(df, "id", {"name": (F.col("name"), 5.0)}, "zzzznothing").count() == 0
    for scores, kept in (([10, 8, 7, 1.2, 0.5], 3), ([10, 0.1, 0.05], 3), ([10, 9, 8, 2, 1.4], 4)):
        df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "id long, score double")
        assert rank.gap_cutoff(df, 50, "score", "id").count() == kept


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r.id: r.score for r in rank.reciprocal_rank_fusion([a, b], "id").collect()}
    assert abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got["x"] - 1 / 61) < 1e-12
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 2), (4, 1)], "id long, cost long")
    assert [r.id for r in rank.within_budget(df, 10, "cost", F.col("id")).orderBy("id").collect()] == [1, 2]


def test_metrics(spark):
    rows = [("t", "d1", 10.0, False, False), ("t", "d1", 20.0, False, False), ("t", "d1", 100.0, True, False), ("t", "d2", 5.0, False, True)]
    df = spark.createDataFrame(rows, "tool string, day string, elapsed double, is_error boolean, is_cached boolean")
    got = {r.day: r for r in usage.tool_metrics(df, "tool", "day").collect()}
    assert (got["d1"].calls, got["d1"].p95, got["d1"].longest, got["d1"].error_rate) == (3, 100.0, 100.0, 0.333)
    assert got["d2"].p50 is None and got["d2"].cache_rate == 1.0
    nums = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert nums.agg(usage.nearest_rank(0.95, "v")).first()[0] == 19
    assert nums.agg(usage.rounded_median("v")).first()[0] == 11


def test_cochange(spark):
    df = spark.createDataFrame([(c, f) for c in (1, 2, 3) for f in "ab"] + [(4, "a")], "c long, f string")
    (r,) = basket.pairs(df, "c", "f").collect()
    assert (r.a, r.b, r.together, r.jaccard) == ("a", "b", 3, 0.75)
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    assert {r.node: r.cluster for r in basket.clusters(chain).collect()} == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50}


def test_roles_and_scores(spark):
    for callers, callees, want in ((6, 2, "utility"), (1, 3, "leaf"), (2, 2, "core"), (0, 9, "dead"), (3, 0, "leaf"), (1, 4, "entry")):
        assert spark.range(1).select(graph.role(F.lit(callers), F.lit(callees))).first()[0] == want


def test_graph_algorithms_match_brute_force(spark):
    rng = random.Random(3)
    edges = {(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(60)) if a != b}
    df = spark.createDataFrame(sorted(edges) + [(0, 0)], "src long, dst long")
    depth, frontier = {0: 0}, {0}
    for k in (1, 2, 3):
        frontier = {b for a, b in edges if a in frontier} - depth.keys()
        depth |= dict.fromkeys(frontier, k)
    assert {r.node: r.depth for r in graph.reach(df, spark.createDataFrame([(0,)], "node long"), 3).collect()} == depth
    want = set()
    for a, b in edges:
        if (b, a) in edges and a < b:
            want.add((a, b))
        want |= {(a, b, c) for c in range(25) if (b, c) in edges and (c, a) in edges and a < b and a < c and b != c}
    assert {tuple(r.path) for r in graph.cycles(df, 3).collect()} == want
    ranks = {r.node: r.rank for r in graph.pagerank(df, 8).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(base, base + 5) if a < b] + [(4, 10)]
    found = {r.node: r.community for r in graph.louvain(spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len(set(found.values())) == 2
    spread = {r.node: r.community for r in graph.label_propagation(spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert set(spread) == set(found)


def test_clones_match_brute_force(spark):
    rng = random.Random(7)
    common = [f"line {i}" for i in range(4)]
    texts = []
    for i in range(60):
        base = rng.sample(range(40), 14)
        texts.append((i, "\n".join([*common, *(f"own {x}" for x in base)])))
        if i % 4 == 0:
            texts.append((100 + i, "\n".join([*common, *(f"own {x}" for x in base[:-rng.randint(1, 4)])])))
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {}
    for k, t in texts:
        sets.setdefault(frozenset(t.split("\n")), (k, len(t.split("\n"))))
    want = set()
    for x, (a, na) in sets.items():
        for y, (b, nb) in sets.items():
            if a < b and max(na, nb) <= 1.3 * min(na, nb):
                s = int(len(x & y) / max(len(x), len(y)) * 100 + 0.5) / 100
                if s >= 0.7 and len(x & y) >= 10:
                    want.add((a, b, s, len(x & y)))
    got = {tuple(r) for r in clones.near(clones.line_sets(df, "id", "text"), least_lines=10).collect()}
    assert got == want and want


def test_rules(spark):
    df = spark.createDataFrame([(1, "try { a() } catch (e) {}\nconsole.log(1)"), (2, "yaml.load(f, Loader=SafeLoader)"), (3, 'yaml.load(f)\ntoken = "0123456789abcdef0123"'), (4, None)], "id long, text string")
    got = {(r.id, r.rule) for r in rules.scan(df, "id", "text", rules.CATALOGUE + rules.SECRETS).collect()}
    assert {(1, "empty-catch"), (1, "console-log"), (3, "yaml-unsafe"), (3, "token-assignment")} <= got and (2, "yaml-unsafe") not in got
    place = {(r.id, r.rule): r.line_no for r in rules.scan(df, "id", "text", rules.CATALOGUE).collect()}
    assert place[1, "console-log"] == 2
    assert one(spark, rules.branch_complexity(F.col("t")), t="if (a) {} else if (b) {} for (;;) {}") == 5
    assert one(spark, rules.nesting_depth(F.col("t")), t="function f() {\n  if (x) {\n    y()\n  }\n}") == 2


def test_sql_text(spark):
    op = lambda s: one(spark, sqltext.migration_operation(F.col("t")), t=s)
    assert op("ALTER TABLE users DROP COLUMN x").operation == "DROP COLUMN" and op("alter table t add column c int").severity == "low"
    assert op("-- DROP TABLE x") is None and op("CREATE UNIQUE INDEX i ON t(a)").operation == "CREATE INDEX"
    assert one(spark, sqltext.dml_finding(F.col("t")), t="DELETE FROM x") == "delete-without-where" and one(spark, sqltext.dml_finding(F.col("t")), t="delete from x where a=1") is None
    schema = "table_name string, column_name string, type string"
    orm = spark.createDataFrame([("users", "id", "int"), ("users", "avatarUrl", "string"), ("orders", "total", "float")], schema)
    sql = spark.createDataFrame([("users", "id", "int"), ("orders", "total", "int"), ("audit_log", "id", "int"), ("users", "created_at", "datetime")], schema)
    assert {(r.table_name, r.column_name, r.drift) for r in sqltext.drift(orm, sql).collect()} == {("users", "avatarUrl", "extra_in_orm"), ("orders", "total", "type_mismatch"), ("audit_log", "id", "extra_in_sql")}


def test_web(spark):
    assert one(spark, web.route_of_file(F.col("t")), t="src/app/(shop)/cart/[id]/page.tsx") == "/cart/[id]"
    ends = spark.createDataFrame([("GET", ["users", "{id}"], "user"), ("GET", ["files", "*"], "files")], "method string, template array<string>, endpoint string")
    calls = spark.createDataFrame([(1, "GET", ["users", "7"]), (2, "GET", ["users"]), (3, "GET", ["files", "a", "b"]), (4, "POST", ["users", "7"])], "id long, method string, segments array<string>")
    assert {(r.id, r.endpoint) for r in web.contracts(ends, calls).collect()} == {(1, "user"), (3, "files")}


def test_retrieval(spark):
    files = spark.createDataFrame([("a.py", "def alpha():\n    return beta()\n"), ("b.py", "def beta():\n    return 1\n" + "# x\n" * 200)], "path string, text string")
    syms = spark.createDataFrame([("s1", "alpha", "function", "a.py", "def alpha()", None, "def alpha():\n    return beta()"), ("s2", "beta", "function", "tests/b.test.py", "def beta()", None, "def beta():\n    return 1")], "id string, name string, kind string, file string, signature string, docstring string, source string")
    got = retrieval.retrieve({"files": files, "symbols": syms}, [{"type": "symbols", "query": "alpha"}, {"type": "references", "symbol_name": "beta"}, {"type": "text", "query": "return"}], 200).collect()
    assert {(r.query_idx, r.key) for r in got} == {(0, "s1"), (1, "a.py:2"), (1, "b.py:1"), (2, "a.py:2"), (2, "b.py:2")}
    assert retrieval.decompose("find the user") == ["find the user"] and len(retrieval.decompose("find all the users that have an open order and also paid")) == 2
    assert code.KEYWORDS


def test_louvain_reads_only_the_edges_of_the_nodes_that_move(spark, monkeypatch):
    """A round's edges are those of one parity: each edge table that is written holds the nodes that move together."""
    from quillspark.operators import graph

    kept, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: kept.append(real(df)) or kept[-1])
    edges = spark.createDataFrame([(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(0, 10)], "src long, dst long")
    got = {r.node: r.community for r in graph.louvain(edges, rounds=6).collect()}
    assert len({got[n] for n in range(5)}) == 1 and len({got[n] for n in range(10, 15)}) == 1 and got[1] != got[11]
    tables = [t for t in kept if set(t.columns) == {"src", "dst"}]
    assert sum(t.count() for t in tables) == 2 * 21
    assert all(t.selectExpr("pmod(xxhash64(src), 2) as p").distinct().count() == 1 for t in tables)
