"""Exact deduplication against brute force: nulls, ties, repeated ids, clashing columns, full bitmaps."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm.exact_dedup import deduplicated, exact_groups

DROP = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def norm(t):
    return (t or "").translate(DROP)


def cases(seed):
    rng = random.Random(seed)
    base = ["", None, " \n", "abc", "a b c", "A b c", "é x", "x" * 300 + "y", "x" * 300 + "z", "x" * 150 + " " + "x" * 150 + "y"]
    rows = [(i, rng.choice(base)) for i in range(60)]
    return rows + [(i, f"own {i}") for i in range(60, 90)]


@pytest.mark.parametrize("words", [1, 1 << 18])  # with one word nearly every row is let through by chance
def test_groups(spark, words):
    rows = cases(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_sha", F.lit("clash")).withColumn("_len", F.lit(1))
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    want = set()
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[1]
        want.add((i, keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert {tuple(r) for r in exact_groups(docs, words=words).collect()} == want


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_filter_keeps_one_row_of_each_group(spark, words):
    rows = [(i, t, "x") for i, t in cases(2)] + [(3, "abc", "y"), (3, "abc", "y"), (None, "only null id", "z"), (None, "abc", "z"), (7, "unique of seven", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_sha` string")
    out = deduplicated(docs, words=words)
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    assert all(k in rows for k in kept)
    assert sorted(norm(t) for _, t, _ in kept) == sorted({norm(t) for _, t, _ in rows})
    longest = {}
    for _, t, _ in rows:
        longest[norm(t)] = max(longest.get(norm(t), 0), len(t or ""))
    assert all(len(t or "") == longest[norm(t)] for _, t, _ in kept)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(none).count() == 0 and deduplicated(none).count() == 0
