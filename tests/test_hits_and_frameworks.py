"""Hit classification, fusions, model hooks, context levels and framework analyses on small cases."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import frameworks as W
from quillspark.operators import hits as H


def test_classified_hits(spark):
    symbols = spark.createDataFrame([("a", "f.ts", "class", 1, 50), ("b", "f.ts", "function", 10, 20)], "id string, file string, kind string, start_line int, end_line int")
    hits = spark.createDataFrame([("f.ts", 12, "x"), ("f.ts", 13, "x"), ("f.ts", 14, "y"), ("f.ts", 40, "z"), ("g.ts", 1, "w")], "file string, line int, text string")
    central = spark.createDataFrame([("f.ts", 1.0)], "file string, centrality double")
    got = {(r.line, r.text, r.symbol): round(r.score, 6) for r in H.classified(hits, symbols, central).collect()}
    assert got == {(12, "x", "b"): 1.7, (14, "y", "b"): 1.7, (40, "z", "a"): 1.05, (1, "w", None): 0.0}


def test_fusions(spark):
    lexical = spark.createDataFrame([(1, 10.0), (2, 4.0)], "t long, score double")
    semantic = spark.createDataFrame([(2, 0.5), (3, 1.0)], "t long, score double")
    assert {r.t: r.score for r in H.conversation_fusion(lexical, semantic, "t").collect()} == {1: 10.0, 2: 5.0, 3: 1.5}
    chunks = spark.createDataFrame([("c1", "f", 1, 40), ("c2", "f", 33, 70)], "id string, file string, start_line int, end_line int")
    got = {r.id: r.score for r in H.chunk_fusion(spark.createDataFrame([("c1", 1)], "id string, rank int"), spark.createDataFrame([("f", 35, 2)], "file string, line int, rank int"), chunks).collect()}
    assert got == {"c1": 1 / 61, "c2": 1 / 62}


def test_model_hooks(spark):
    best = spark.createDataFrame([(i, "x" * i, 10.0 - i) for i in range(1, 6)], "id long, text string, score double")
    listed = H.reranked(best, lambda s: s.str.len().astype(float), "text", "score", "id", most=3).orderBy("place").collect()
    assert [r.id for r in listed] == [3, 2, 1, 4, 5]
    assert [r.id for r in H.reranked(best, None, "text", "score", "id").orderBy("place").collect()] == [1, 2, 3, 4, 5]
    embed = H.static_embedding({"play": 0, "##ing": 1, "!": 2}, np.eye(3))
    rows = spark.createDataFrame([("Playing",), ("zzz",), ("play !",)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert np.allclose(rows[0].v, [0.5**0.5, 0.5**0.5, 0]) and rows[1].v == [0, 0, 0] and np.allclose(rows[2].v, [0.5**0.5, 0, 0.5**0.5])


def test_context_levels_and_suggestions(spark):
    ranked = spark.createDataFrame([("1", "a/x.py", "function", "f", "s" * 70, 3.0), ("2", "a/y.py", "class", "g", "s" * 35, 2.0), ("3", "b/z.py", "class", "h", None, 1.0)], "id string, file string, kind string, name string, source string, score double")
    assert [r.key for r in H.context(0, ranked, 20).orderBy("running").collect()] == ["1"]
    assert [r.key for r in H.context(3, ranked, 100).orderBy("running").collect()] == ["a", "b"]
    assert H.context(1, ranked, 100).count() == 3 and H.context(2, ranked, 100).count() == 3
    names = spark.createDataFrame([("getUser",), ("setUser",), ("other",)], "name string")
    assert [r.name for r in H.suggestions(names, "getuser", 2).collect()] == ["getUser", "setUser"]


def test_framework_scores(spark):
    parts = spark.createDataFrame([("a", 100, 5, 1, 2), ("b", 300, 1, 0, 0)], "file string, loc int, imports int, dynamic_imports int, third_party int")
    assert [(r.file, r.score) for r in W.client_boundary_rank(parts).collect()] == [("b", 320), ("a", 200)]
    (r,) = W.weighted_audit(spark.createDataFrame([("x", 90.0, 2.0), ("y", 60.0, 1.0)], "dimension string, score double, weight double")).collect()
    assert (r.score, r.issues) == (80, 1)


def test_middleware(spark):
    routes = spark.createDataFrame([("/admin/users",), ("/api/x",), ("/",)], "route string")
    got = {r.route: (r.protected, r.severity) for r in W.middleware_coverage(routes, ["/api/:path*"]).collect()}
    assert got == {"/admin/users": (False, "high"), "/api/x": (True, None), "/": (False, None)}
    entries = spark.createDataFrame([("*", 1, "log", False), ("/api/*", 2, "auth", True), ("/web/*", 3, "csrf", False)], "scope string, position int, name string, conditional boolean")
    chain = W.middleware_chain(spark.createDataFrame([("GET", "/api/x")], "method string, path string"), entries).orderBy("step").collect()
    assert [(r.step, r.name) for r in chain] == [(1, "log"), (2, "auth")]


def test_declarations_and_components(spark):
    d = spark.createDataFrame([("f", "fun", "expect", "common"), ("f", "fun", "actual", "jvm"), ("g", "fun", "actual", "ios")], "name string, kind string, modifier string, platform string")
    got = {r.name: (r.expected, r.missing) for r in W.expect_actual(d, ["jvm", "ios"]).collect()}
    assert got == {"f": (True, ["ios"]), "g": (False, [])}
    findings = spark.createDataFrame([("A", "compiler-ref-read-in-render"), ("B", "compiler-redundant-memo")], "component string, rule string")
    (r,) = W.compiler_readiness(findings, spark.createDataFrame([("A",), ("B",), ("C",)], "component string")).collect()
    assert tuple(r) == (3, 2, 1, 1)


def test_php_and_prisma(spark):
    m = spark.createDataFrame([("1", "foreach ($users as $u) { echo $u->orders->count; echo $u->name->x; }"), ("2", "User::with('orders')->get(); foreach ($users as $u) { $u->orders->count(); }")], "id string, source string")
    assert [tuple(r) for r in W.n_plus_one(m).collect()] == [("1", "orders")]
    codes = spark.createDataFrame([(1, "prisma.user.findMany({ where: { a: 1 }, take: 5 })"), (2, "await prisma.post.deleteMany({})"), (3, "none"), (4, "prisma.a.findMany({ take: 5, skip: 5000 })")], "id long, code string")
    got = {r.id: r.e for r in codes.select("id", W.explain_prisma(F.col("code")).alias("e")).collect()}
    assert got[1].sql == "SELECT * FROM user WHERE ... LIMIT 5" and got[1].warning is None
    assert got[2].warning == "touches every row" and got[3] is None and got[4].warning.startswith("large offset")


def test_gates_and_memories(spark):
    gates = spark.createDataFrame([("circular", "ok"), ("types", "timeout")], "check string, status string")
    findings = spark.createDataFrame([("circular", "error"), ("circular", "warning")], "check string, severity string")
    got = {r.check: (r.status, r.high, r.medium) for r in W.gate_summary(findings, gates).collect()}
    assert got == {"circular": ("ok", 1, 1), "types": ("timeout", 0, 0)}
    mem = spark.createDataFrame([("Same text", 6), ("same TEXT", 2), ("other", 3)], "summary string, score int")
    assert {(r.summary, r.confidence) for r in W.deduplicated_memories(mem).collect()} == {("Same text", "high"), ("other", "medium")}
