"""Graph analytics over edge tables ``(src, dst)``.

Degrees, roles and scores are aggregates and equi joins. Reachability, components and PageRank iterate
joins on node keys; each round's frontier is deduplicated before the next. Louvain's local moves are made half of
the nodes at a time, as joins; none of the graphs needs to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, fan_in, fan_out)`` by distinct neighbours."""
    e = distinct_edges(edges)
    both = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def sorted_index(df: DataFrame, col: str, share: float) -> DataFrame:
    """One row ``value``: the sorted values' entry at floor(share n), by counts per value (few rows whatever the table's size)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("c", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return cum.where(F.col("c") > F.floor(F.col("all") * share)).agg(F.min(col).alias("value"))


def hubs(deg: DataFrame, share: float = 0.75) -> DataFrame:
    """Nodes above the share's value in both directions."""
    a, b = sorted_index(deg, "fan_in", share), sorted_index(deg, "fan_out", share)
    cut = a.select(F.col("value").alias("cut_in")).crossJoin(b.select(F.col("value").alias("cut_out")))
    return deg.crossJoin(F.broadcast(cut)).where("fan_in > cut_in and fan_out > cut_out").select("node", "fan_in", "fan_out")


def role(callers: Column, callees: Column) -> Column:
    ratio = callers / callees
    return (
        F.when(callers == 0, "dead").when(callees == 0, "leaf").when((ratio >= 3) & (callers >= 3), "utility")
        .when((ratio <= 0.33) & (callees >= 3), "entry").when((callers >= 2) & (callees >= 2), "core").otherwise("leaf")
    )


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)`` of everything within ``depth`` steps of the seeds ``(node)``, at its least depth."""
    e = distinct_edges(edges)
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        found = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Elementary cycles of up to ``longest`` nodes, each once, from its least node, as ``path`` (array)."""
    e = distinct_edges(edges)
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = None
    for k in range(2, longest + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        closed = paths.join(e, (last == e["src"]) & (first == e["dst"])).select("path")
        found = closed if found is None else found.unionByName(closed)
        if k < longest:
            paths = paths.join(e, (last == e["src"]) & (e["dst"] > first)).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``(node, rank)``: fixed rounds, without self loops and repeats; dangling nodes give to all."""
    e = written(distinct_edges(edges))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    n = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    base = written(nodes.join(out, nodes["node"] == out["src"], "left").select("node", "out").crossJoin(F.broadcast(n)))
    ranks = base.select("node", "out", "n", (1 / F.col("n")).alias("rank"))
    for _ in range(rounds):
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        given = ranks.where("out is not null").join(e, ranks["node"] == e["src"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        fresh = base.join(given, base["node"] == given["dst"], "left").crossJoin(F.broadcast(dangling))
        ranks = written(fresh.select("node", "out", "n", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank")))
    return ranks.select("node", "rank")


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: the sum over linked pairs of one community of (A - k k / 2m), by 2m. ``member``: (node, community)."""
    e = distinct_edges(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    k = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    m2 = e.agg((2.0 * F.count(F.lit(1))).alias("m2"))
    info = k.join(member, "node")
    a = info.select(F.col("node").alias("src"), F.col("k").alias("ka"), F.col("community").alias("ca"))
    b = info.select(F.col("node").alias("dst"), F.col("k").alias("kb"), F.col("community").alias("cb"))
    inside = e.join(a, "src").join(b, "dst").where("ca = cb").crossJoin(F.broadcast(m2))
    return inside.agg(F.coalesce(F.sum(2 * (1 - F.col("ka") * F.col("kb") / F.col("m2")) / F.col("m2")), F.lit(0.0)).alias("modularity"))


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Per community: inner and outer edges, and inner / (inner + outer)."""
    e = distinct_edges(edges)
    a, b = member.select(F.col("node").alias("src"), F.col("community").alias("ca")), member.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    both = e.join(a, "src").join(b, "dst")
    ends = both.select(F.col("ca").alias("community"), (F.col("ca") == F.col("cb")).alias("inner")).unionByName(both.where("ca <> cb").select(F.col("cb").alias("community"), F.lit(False).alias("inner")))
    out = ends.groupBy("community").agg(F.count_if(F.col("inner")).alias("internal"), F.count_if(~F.col("inner")).alias("external"))
    return out.withColumn("cohesion", F.col("internal") / (F.col("internal") + F.col("external")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(node, community)``: each round a node takes the most frequent label of its neighbours, ties to the least."""
    e = distinct_edges(edges)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both)
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = votes.groupBy("src").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")).withColumnRenamed("src", "node")
    return labels


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 10) -> DataFrame:
    """``(node, community)`` by local moves that raise modularity, half of the nodes at a time.

    In each round the nodes of one parity of their hash move, each to the neighbouring community with the largest gain
    ``w(v, c) - resolution * k(v) * weight(c) / 2m`` (its own weight left out), ties to the least community, and only if
    that is more than staying. Two linked nodes of one parity may move at once; so a fixed number of rounds is
    made. A round is joins and aggregates over the edges, so the graph needs to fit no task.
    """
    e = distinct_edges(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # a round reads the edges of the nodes that move in it only
    parity = lambda node: F.pmod(F.xxhash64(node), F.lit(2))
    sides = [written(both.where(parity("src") == p)) for p in (0, 1)]
    degree = sides[0].unionByName(sides[1]).groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    home = written(degree.select(F.col("src").alias("node"), "k", F.col("src").alias("community")))
    total = home.agg(F.sum("k").alias("m2")).first()["m2"] or 1
    for r in range(rounds):
        # a community's weight goes along with its name, so no join by communities is as long as the edges
        weighed = home.join(home.groupBy("community").agg(F.sum("k").alias("weight")), "community")
        heard = sides[r % 2].join(weighed.select(F.col("node").alias("dst"), "community", "weight"), "dst").select("src", "community", "weight", F.lit(1).cast("long").alias("w"))
        turn = home.where(parity("node") == r % 2).select(F.col("node").alias("src"), "k", F.col("community").alias("own"))
        # staying is an option even without a link to the own community
        stay = weighed.where(parity("node") == r % 2).select(F.col("node").alias("src"), "community", "weight", F.lit(0).cast("long").alias("w"))
        # a node's options meet in one partition: sums, degree and choice take no further exchange of them
        options = heard.unionByName(stay).repartition("src").groupBy("src", "community").agg(F.first("weight").alias("weight"), F.sum("w").alias("w")).join(turn, "src")
        others = F.col("weight") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / total, 9)
        best = options.groupBy("src").agg(F.max_by("community", F.struct(gain.alias("gain"), (F.col("community") == F.col("own")).alias("stay"), (-F.col("community")).alias("least"))).alias("to"))
        home = written(home.join(best, home["node"] == best["src"], "left").select("node", "k", F.coalesce("to", "community").alias("community")))
    return home.select("node", "community")
