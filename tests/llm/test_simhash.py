"""SimHash against a brute-force version, and on the cases its docstrings define."""

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.simhash import _dealt, _hot_prefixes, fingerprint, fingerprint_links, shingles, simhash_components, words_of


def brute(texts):
    def one(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return {i: one(t) for i, t in texts}


def closure(prints, radius=4):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(300)]
    texts = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        texts.append((len(texts), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((len(texts), rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    texts += [(len(texts), None), (len(texts) + 1, ""), (len(texts) + 2, " \n"), (len(texts) + 3, "two words"), (len(texts) + 4, "two words"), (len(texts) + 5, "w " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    prints = brute(texts)
    want = {(i, f"{p:016x}", c) for (i, p), c in zip(prints.items(), closure(prints).values(), strict=True)}
    assert {tuple(r) for r in simhash_components(docs).collect()} == want


def test_links_in_dense_balls_and_small_chunks(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(0, v) for v in signed], "view int, fp long")
    want = closure(dict(zip(signed, values, strict=True)))
    groups = {}
    for node, root in want.items():
        groups.setdefault(root, set()).add(node)
    want_sets = {frozenset(g) for g in groups.values() if len(g) > 1}
    for settings in ({"chunk": 1_000}, {"chunk": 4_000_000, "prefix": 12}, {"limit": 20}, {"prefix": 2, "limit": 3}):
        found = {}
        for u, root in components(fingerprint_links(df, **settings)).collect():
            found.setdefault(root, {root}).add(u)
        assert {frozenset(g) for g in found.values()} == want_sets


def test_one_prefix_with_ten_times_what_a_task_holds(spark):
    rng, held, top = random.Random(4), 1000, 0b101101 << 58
    centres = [rng.getrandbits(58) for _ in range(5 * held)]
    values = {top | c for c in centres} | {top | c ^ (1 << rng.randrange(58)) ^ (1 << rng.randrange(58)) for c in centres}
    assert len(values) > 9.9 * held
    signed = [v - (1 << 64) for v in values]
    df = spark.createDataFrame([(0, v) for v in signed], "view int, fp long")
    hot = _hot_prefixes(df, 64, 6, 2, held)
    assert len(hot) >= 1 and all(len(h) for h in hot)
    most = Counter()
    for keys, _ in _dealt(np.zeros(len(signed), np.int32), np.array(signed, np.int64).view(np.uint64), 64, 6, 2, hot):
        most.update(keys.tolist())
    assert max(most.values()) <= held
    got = {u: r for u, r in components(fingerprint_links(df, prefix=6, limit=held, chunk=held)).collect()}
    near = {c - (1 << 64) if c >> 63 else c for c in (top | c for c in centres)}
    assert len({got.get(v, v) for v in signed}) <= len(near)  # every copy is with its centre
    plain = {u: r for u, r in components(fingerprint_links(df, prefix=12)).collect()}
    assert got == plain


def test_empty_table_and_repeated_rows(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in simhash_components(twice).orderBy("doc_id").collect()] == [(1, 1), (3, 1), (3, 1)]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{1000 + k: 1000 for k in range(1, 50)}}


def test_shingles_keep_repeats():
    assert shingles(words_of("A b\ta b a b"), 4) == [b"a b a b", b"b a b a", b"a b a b"]
    assert fingerprint([]) == 0 and shingles([], 4) == [] and np.uint64(fingerprint([b"x"])) == xxhash.xxh64_intdigest(b"x", 42)
