"""Queries over graphs and baskets: lineitem is the change log (orders are commits, parts files), parts and suppliers an import graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import basket as B
from ..operators import graph as G
from ..operators import rank as R
from .base import table


def _uses(spark, sf):
    """Supplier -> part edges; parts are numbered behind the suppliers."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).distinct()


def _calls(spark, sf):
    """Part -> part edges: each line of an order calls the next one's part."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"))
    a, b = li.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src")), li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "n"]).select("src", "dst").where("src <> dst").distinct()


def _baskets(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))


def cochange_pairs(spark, sf):
    found = B.pairs(_baskets(spark, sf), "l_orderkey", "item", support=2, jaccard=0.02)
    return R.top(found.withColumn("jaccard", R.rounded(F.col("jaccard"))), 30, "jaccard", "a", "b")


def cochange_clusters(spark, sf):
    return B.clusters(B.pairs(_baskets(spark, sf), "l_orderkey", "item", support=2, jaccard=0.032)).withColumnRenamed("cluster", "cluster_id")


def hotspots(spark, sf):
    churn = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("commits"), F.sum("l_quantity").alias("changed"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    scored = churn.join(part, "l_partkey", "left").select("l_partkey", "commits", "changed", (F.col("commits") * F.col("changed") * F.greatest(F.coalesce("p_size", F.lit(0)), F.lit(1))).alias("score"))
    return R.top(scored, 20, "score", "l_partkey")


def fan_in_fan_out(spark, sf):
    return G.degrees(_uses(spark, sf))


def hub_files(spark, sf):
    return G.hubs(G.degrees(_calls(spark, sf)))


def coupling_score(spark, sf):
    deg = G.degrees(_calls(spark, sf))
    n = deg.agg(F.count(F.lit(1)).alias("files"))
    h = G.hubs(deg).agg(F.count(F.lit(1)).alias("hubs"))
    return n.crossJoin(h).select("files", "hubs", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - 100 * F.col("hubs") / F.col("files") + 0.5))).cast("long").alias("score"))


def symbol_roles(spark, sf):
    deg = G.degrees(_calls(spark, sf))
    return deg.select("node", "fan_in", "fan_out", G.role(F.col("fan_in"), F.col("fan_out")).alias("role"))


def bfs_reach(spark, sf):
    seeds = spark.createDataFrame([(1,), (2,)], "node long")
    return G.reach(_calls(spark, sf), seeds, 3).select("node", F.col("depth").cast("long").alias("depth"))


def circular_deps(spark, sf):
    return G.cycles(_calls(spark, sf), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))


def pagerank_fixed_iter(spark, sf):
    return G.pagerank(_calls(spark, sf), 5).select("node", R.rounded(F.col("rank"), 8).alias("rank"))


def _member(edges):
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.withColumn("community", F.col("node") % 5)


def modularity_by_label(spark, sf):
    e = _calls(spark, sf)
    return G.modularity(e, _member(e)).select(R.rounded(F.col("modularity"), 8).alias("modularity"))


def community_cohesion(spark, sf):
    e = _calls(spark, sf)
    return G.cohesion(e, _member(e)).select("community", "internal", "external", R.rounded(F.col("cohesion"), 8).alias("cohesion"))


def louvain_communities(spark, sf):
    return G.louvain(_calls(spark, sf))


def surprise_scores(spark, sf):
    """Community pairs: links against what their sizes let expect, and the strongest co-change across them."""
    e = _calls(spark, sf)
    member = _member(e)
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    total = e.agg(F.count(F.lit(1)).alias("m")).crossJoin(member.agg(F.count(F.lit(1)).alias("v"))).select((F.col("m") / (F.col("v") * F.col("v"))).alias("density"))
    cross = e.select((F.col("src") % 5).alias("x"), (F.col("dst") % 5).alias("y")).where("x <> y").select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))
    links = cross.groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("links"))
    pairs = B.pairs(_baskets(spark, sf), "l_orderkey", "item", support=2, jaccard=0.0)
    strong = pairs.select((F.col("a") % 5).alias("x"), (F.col("b") % 5).alias("y"), "jaccard").where("x <> y").select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"), "jaccard").groupBy("ca", "cb").agg(F.max("jaccard").alias("j"))
    sized = links.join(size.select(F.col("community").alias("ca"), F.col("n").alias("na")), "ca").join(size.select(F.col("community").alias("cb"), F.col("n").alias("nb")), "cb")
    scored = sized.join(strong, ["ca", "cb"], "left").crossJoin(F.broadcast(total))
    return scored.select("ca", "cb", "links", R.rounded(0.6 * F.col("links") / (F.col("na") * F.col("nb") * F.col("density")) + 0.4 * F.coalesce("j", F.lit(0.0))).alias("score"))


def dead_parts(spark, sf):
    """Exported symbols that nothing references: parts that no order holds."""
    return table(spark, sf, "part").join(table(spark, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


def dead_tokens(spark, sf):
    """Tokens that occur in one document only, per document."""
    from ..functions.text import tokenize

    tokens = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    single = tokens.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return single.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own_tokens"))


def review_score(spark, sf):
    """Orders as diffs: returned lines are tier 1, discounts tier 2, the rest tier 3."""
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("t1"), F.count_if((F.col("l_returnflag") != "R") & (F.col("l_discount") > 0.05)).alias("t2"), F.count_if((F.col("l_returnflag") != "R") & (F.col("l_discount") <= 0.05)).alias("t3"))
    second = F.lit(100) - 20 * F.col("t1") - 5 * F.col("t2")
    third = second - F.col("t3")
    score = F.when(F.col("t1") > 0, F.greatest(third, F.lit(0))).when(F.col("t2") > 0, F.greatest(third, F.lit(20))).otherwise(F.greatest(third, F.lit(50)))
    return per.select("l_orderkey", score.alias("score"), F.when(score >= 80, "pass").when(score >= 50, "warn").otherwise("fail").alias("verdict"))


def risk_scores(spark, sf):
    deg = G.degrees(_calls(spark, sf))
    raw = F.least(10 * F.col("fan_in"), F.lit(40)) + F.when(F.col("node") % 3 == 0, 30).otherwise(0) + F.least(5 * F.col("fan_out"), F.lit(30))
    risk = F.least(raw, F.lit(100))
    return deg.select("node", risk.alias("risk"), F.when(risk >= 70, "critical").when(risk >= 50, "high").when(risk >= 25, "medium").otherwise("low").alias("level"))


def boundary_violations(spark, sf):
    """Customers' nations may not order from some nations' suppliers: edges against rules, by substring."""
    rules = spark.createDataFrame([("NATION_1", "NATION_2"), ("NATION_3", "NATION_1")], "rule_from string, cannot string")
    nation = table(spark, sf, "nation")
    buyers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("buyer"))
    sellers = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("seller"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("buyer", "seller").agg(F.count(F.lit(1)).alias("edges"))
    broken = F.contains("buyer", F.col("rule_from")) & F.contains("seller", F.col("cannot"))
    return edges.join(F.broadcast(rules), broken).select("buyer", "seller", "rule_from", "cannot", "edges")


def dir_rollup(spark, sf):
    """Region/nation as directories of customers."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy(F.concat_ws("/", "r_name", "n_name").alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("languages"))


def kind_histogram(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("names"))


QUERIES = {f.__name__: f for f in [
    cochange_pairs, cochange_clusters, hotspots, fan_in_fan_out, hub_files, coupling_score, symbol_roles, bfs_reach, circular_deps, pagerank_fixed_iter,
    modularity_by_label, community_cohesion, louvain_communities, surprise_scores, dead_parts, dead_tokens, review_score, risk_scores,
    boundary_violations, dir_rollup, kind_histogram,
]}

_CALLS = """calls AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
_DEG = "deg AS (SELECT node, sum(i)::bigint AS fan_in, sum(o)::bigint AS fan_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM calls UNION ALL SELECT src, 0, 1 FROM calls) GROUP BY node)"
_HUB = "cut AS (SELECT list_sort(list(fan_in))[floor(count(*) * 0.75)::int + 1] AS ci, list_sort(list(fan_out))[floor(count(*) * 0.75)::int + 1] AS co FROM deg), hub AS (SELECT node, fan_in, fan_out FROM deg, cut WHERE fan_in > ci AND fan_out > co)"
_BASKET = """b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem), ok AS (SELECT o FROM b GROUP BY o HAVING count(*) BETWEEN 2 AND 50), sup AS (SELECT i, count(*) AS s FROM b GROUP BY i),
    pr AS (SELECT x.i AS a, y.i AS b, count(*) AS together FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN ok ON ok.o = x.o GROUP BY ALL HAVING count(*) >= 2),
    jac AS (SELECT pr.a, pr.b, together, together / (sa.s + sb.s - together) AS jaccard FROM pr JOIN sup sa ON sa.i = pr.a JOIN sup sb ON sb.i = pr.b)"""
_MEMBER = "nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), member AS (SELECT node, node % 5 AS community FROM nodes)"


def _rank_sql(rounds: int) -> str:
    out = f"WITH {_CALLS}, nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), base AS MATERIALIZED (SELECT node, o, (SELECT count(*) FROM nodes)::double AS n FROM nodes LEFT JOIN (SELECT src, count(*) AS o FROM calls GROUP BY 1) ON src = node), r0 AS (SELECT node, o, n, 1 / n AS rank FROM base)"
    for k in range(rounds):
        out += f", r{k + 1} AS MATERIALIZED (SELECT base.node, base.o, base.n, 0.15 / base.n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (o IS NULL), 0) FROM r{k}) / base.n) AS rank FROM base LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM r{k} JOIN calls ON src = node GROUP BY dst) g ON g.dst = base.node)"
    return out + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


SQL = {
    "cochange_pairs": f"WITH {_BASKET} SELECT a, b, together, round(jaccard, 6) AS jaccard FROM jac WHERE jaccard >= 0.02 ORDER BY 4 DESC, 1, 2 LIMIT 30",
    "cochange_clusters": f"WITH RECURSIVE {_BASKET}, e AS (SELECT a AS u, b AS v FROM jac WHERE jaccard >= 0.032 UNION SELECT b, a FROM jac WHERE jaccard >= 0.032), r AS (SELECT DISTINCT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node) SELECT node, min(c) AS cluster_id FROM r GROUP BY node",
    "hotspots": "SELECT l_partkey, count(DISTINCT l_orderkey) AS commits, sum(l_quantity) AS changed, count(DISTINCT l_orderkey) * sum(l_quantity) * greatest(coalesce(max(p_size), 0), 1) AS score FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20",
    "fan_in_fan_out": "WITH calls AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem), " + _DEG + " SELECT * FROM deg",
    "hub_files": f"WITH {_CALLS}, {_DEG}, {_HUB} SELECT * FROM hub",
    "coupling_score": f"WITH {_CALLS}, {_DEG}, {_HUB}, f AS (SELECT count(*) AS files FROM deg), h AS (SELECT count(*) AS hubs FROM hub) SELECT files, hubs, greatest(0, least(100, floor(100 - 100 * hubs / files + 0.5)))::bigint AS score FROM f, h",
    "symbol_roles": f"WITH {_CALLS}, {_DEG} SELECT *, CASE WHEN fan_in = 0 THEN 'dead' WHEN fan_out = 0 THEN 'leaf' WHEN fan_in / fan_out >= 3 AND fan_in >= 3 THEN 'utility' WHEN fan_in / fan_out <= 0.33 AND fan_out >= 3 THEN 'entry' WHEN fan_in >= 2 AND fan_out >= 2 THEN 'core' ELSE 'leaf' END AS role FROM deg",
    "bfs_reach": f"WITH RECURSIVE {_CALLS}, r AS (SELECT unnest([1, 2])::bigint AS node, 0::bigint AS depth UNION SELECT dst, depth + 1 FROM r JOIN calls ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "circular_deps": f"WITH {_CALLS}, e AS (SELECT * FROM calls) SELECT a.src || '>' || a.dst AS cycle FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst",
    "pagerank_fixed_iter": _rank_sql(5),
    "modularity_by_label": f"WITH {_CALLS}, e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM calls), k AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), m AS (SELECT 2.0::double * count(*) AS m2 FROM e) SELECT round(sum(2 * (1 - a.k * b.k / m2) / m2), 8) AS modularity FROM e JOIN k a ON a.node = src JOIN k b ON b.node = dst, m WHERE src % 5 = dst % 5",
    "community_cohesion": f"WITH {_CALLS}, x AS (SELECT src % 5 AS community, src % 5 = dst % 5 AS i FROM calls UNION ALL SELECT dst % 5, false FROM calls WHERE src % 5 <> dst % 5) SELECT community, count(*) FILTER (i) AS internal, count(*) FILTER (NOT i) AS external, round(count(*) FILTER (i) / count(*), 8) AS cohesion FROM x GROUP BY 1",
    "surprise_scores": f"""WITH {_CALLS}, {_MEMBER}, {_BASKET}, sz AS (SELECT community, count(*) AS n FROM member GROUP BY 1), den AS (SELECT (SELECT count(*) FROM calls) / ((SELECT count(*) FROM member) * (SELECT count(*) FROM member)) AS density),
        lk AS (SELECT least(src % 5, dst % 5) AS ca, greatest(src % 5, dst % 5) AS cb, count(*) AS links FROM calls WHERE src % 5 <> dst % 5 GROUP BY 1, 2), st AS (SELECT least(a % 5, b % 5) AS ca, greatest(a % 5, b % 5) AS cb, max(jaccard) AS j FROM jac WHERE a % 5 <> b % 5 GROUP BY 1, 2)
        SELECT lk.ca, lk.cb, links, round(0.6 * links / (x.n * y.n * density) + 0.4 * coalesce(j, 0), 6) AS score FROM lk JOIN sz x ON x.community = ca JOIN sz y ON y.community = cb LEFT JOIN st ON st.ca = lk.ca AND st.cb = lk.cb, den""",
    "dead_parts": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "review_score": """WITH p AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS t1, count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.05) AS t2, count(*) FILTER (l_returnflag <> 'R' AND l_discount <= 0.05) AS t3 FROM lineitem GROUP BY 1),
        s AS (SELECT l_orderkey, greatest(100 - 20 * t1 - 5 * t2 - t3, CASE WHEN t1 > 0 THEN 0 WHEN t2 > 0 THEN 20 ELSE 50 END)::bigint AS score FROM p) SELECT *, CASE WHEN score >= 80 THEN 'pass' WHEN score >= 50 THEN 'warn' ELSE 'fail' END AS verdict FROM s""",
    "risk_scores": f"WITH {_CALLS}, {_DEG}, r AS (SELECT node, least(least(10 * fan_in, 40) + CASE WHEN node % 3 = 0 THEN 30 ELSE 0 END + least(5 * fan_out, 30), 100)::bigint AS risk FROM deg) SELECT *, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM r",
    "boundary_violations": """WITH e AS (SELECT cn.n_name AS buyer, sn.n_name AS seller, count(*) AS edges FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2),
        r(rule_from, cannot) AS (VALUES ('NATION_1', 'NATION_2'), ('NATION_3', 'NATION_1')) SELECT buyer, seller, rule_from, cannot, edges FROM e, r WHERE contains(buyer, rule_from) AND contains(seller, cannot)""",
    "dir_rollup": "SELECT r_name || '/' || n_name AS dir, count(*) AS files, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS languages FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "kind_histogram": "SELECT p_type AS kind, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY 1",
}


def _dead_sql() -> str:
    from .base import sql_tokens

    return f"WITH t AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS token FROM documents), s AS (SELECT token, min(doc_id) AS doc_id FROM t GROUP BY 1 HAVING count(*) = 1) SELECT doc_id, count(*) AS own_tokens FROM s GROUP BY 1"


SQL["dead_tokens"] = _dead_sql()
