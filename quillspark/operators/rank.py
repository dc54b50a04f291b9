"""Ranked retrieval: fielded BM25, vector similarity, rank fusion, cut-offs and budgets.

A search reads its table twice and shuffles nothing but sums: term frequencies of the query's tokens are
counted in each row, document frequencies and lengths are one aggregate row, and the ranking is a top-k.
``postings`` builds the inverted index as a table for many searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_tokens, tokenize

K1, B = 1.2, 0.75


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


def postings(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``(field, token, key, tf)`` of every token in every field."""
    parts = [df.select(F.lit(f).alias("field"), F.col(key), F.explode(tokenize(c)).alias("token")) for f, c in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("field", "token", key).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(df: DataFrame, text: Column) -> DataFrame:
    """``(token, df, idf)`` over all rows."""
    tokens = df.select(F.explode(F.array_distinct(tokenize(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return tokens.crossJoin(F.broadcast(n)).select("token", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def bm25(df: DataFrame, key: str, fields: dict[str, tuple[Column, float]], query: str, boost: Column | None = None) -> DataFrame:
    """``(key, score)`` of the rows with a positive score.

    Fields carry weights; the query's tokens count with repeats. Averages are over all rows, rows without
    tokens among them. ``boost``: a factor for each row.
    """
    terms = query_tokens(query)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    names = list(fields)

    def equal(term: str):
        return lambda t: t == term

    def counts(tokens: Column) -> Column:
        tf = [F.size(F.filter(tokens, equal(q))).alias(f"tf{j}") for j, q in enumerate(distinct)]
        return F.struct(F.size(tokens).alias("n"), *tf)

    # a lambda binds the tokens and the generator keeps filters above it: each text is tokenized once in a scan
    per_field = [F.get(F.transform(F.array(tokenize(c)), counts), F.lit(0)).alias(f"f{i}") for i, (c, _) in enumerate(fields.values())]
    once = df.select(F.col(key), (boost if boost is not None else F.lit(1.0)).alias("boost"), F.explode(F.array(F.struct(*per_field))).alias("s"))
    counted = once.select(
        F.col(key), "boost",
        *[F.col(f"s.f{i}.n").alias(f"n{i}") for i in range(len(names))],
        *[F.col(f"s.f{i}.tf{j}").alias(f"tf{i}_{j}") for i in range(len(names)) for j in range(len(distinct))],
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.avg(f"n{i}").alias(f"avg{i}") for i in range(len(names))],
        *[F.sum((F.col(f"tf{i}_{j}") > 0).cast("long")).alias(f"df{i}_{j}") for i in range(len(names)) for j in range(len(distinct))],
    )
    score = F.lit(0.0)
    for i, (_, weight) in enumerate(fields.values()):
        ratio = F.when(F.col(f"avg{i}") > 0, F.col(f"n{i}") / F.col(f"avg{i}")).otherwise(1.0)
        for j, q in enumerate(distinct):
            tf, d = F.col(f"tf{i}_{j}"), F.col(f"df{i}_{j}")
            idf = F.ln((F.col("docs") - d + 0.5) / (d + 0.5) + 1)
            score = score + weight * terms.count(q) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
    hit = F.lit(False)
    for i in range(len(names)):
        for j in range(len(distinct)):
            hit = hit | (F.col(f"tf{i}_{j}") > 0)
    # one row of statistics
    return counted.where(hit).crossJoin(F.broadcast(stats)).select(F.col(key), (score * F.col("boost")).alias("score"))


def top(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def ranked(df: DataFrame, k: int, score: str, tie: str, name: str = "rank") -> DataFrame:
    """The k best rows with their rank from 1. The window is over k rows."""
    return top(df, k, score, tie).withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), tie)))


def gap_cutoff(df: DataFrame, k: int, score: str, tie: str, share: float = 0.15, least: int = 3) -> DataFrame:
    """The k best, cut after ``least`` rows where the score falls below a share of the best."""
    best = ranked(df, k, score, tie).withColumn("_top", F.max(score).over(Window.partitionBy()))
    return best.where((F.col("rank") <= least) | (F.col("_top") <= 0) | (F.col(score) >= share * F.col("_top"))).drop("_top")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if the dimensions differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """``(query, key, score, rank)``: the k nearest rows of each query ``(query, qvec)``.

    Every row is compared with each stated query, in blocks of at most ``block`` queries that are sent to every task;
    each block reads the table once.
    """
    rows, found = queries.count(), None
    blocks = max(1, -(-rows // block))
    window = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        scored = df.crossJoin(F.broadcast(part)).select("query", F.col(key), cosine(F.col(vector), F.col("qvec")).alias("score"))
        best = scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
    return found


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """``(key, score)``: the sum of 1 / (constant + rank) over lists ``(key, rank)``."""
    union = lists[0].select(key, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select(key, "rank"))
    return union.groupBy(key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def within_budget(df: DataFrame, budget: int, cost: str, *order: Column) -> DataFrame:
    """The longest prefix in that order whose costs sum to the budget at most.

    Costs are positive, so no more than ``budget`` rows can fit: the running sum is over those only.
    """
    first = df.orderBy(*order).limit(budget)
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("running", running).where(F.col("running") <= budget)


def tool_score(lexical: Column, identity: Column, semantic: Column, usage: Column, framework: Column) -> Column:
    """The five signals' weighted sum; lexical and usage are shares of their maxima."""
    return lexical + 2 * identity + 0.8 * semantic + 0.1 * usage + 0.6 * framework
