"""Near-duplicate removal and the pipeline, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import near_dedup
from quillspark.llm.common import table
from quillspark.llm.near_dedup import near_deduplicated

SF = "/root/testdata/sf0.01"


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near_copies_go_and_clean_texts_stay(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(800)]
    texts, copies = [], set()
    for _ in range(80):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(max(1, len(base) // 120)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            if similar(shingle_set(" ".join(near)), shingle_set(texts[-1])):
                copies.add(len(texts))
            texts.append(" ".join(near))
    big = rng.choices(vocabulary, k=200)
    for _ in range(150):  # a large group
        near = list(big)
        near[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (9000, None, "x"), (9001, "", "x"), (9002, " \n", "x")], "doc_id long, text string, `group` string")
    kept = near_deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and 9000 in ids and 9001 not in ids and 9002 not in ids
    ids = [i for i in ids if i is not None and i < 9000]
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    for i in set(range(len(texts))) - set(ids):
        assert any(similar(sets[i], sets[j]) for j in range(len(texts)) if j != i)  # nothing clean goes
    for n, i in enumerate(ids):
        left = [j for j in ids[n + 1 :] if similar(sets[i], sets[j])]
        assert len(left) <= 1
    assert len(ids) <= len(texts) - 149 - 0.9 * len(copies) + 5


def least_of_groups(sets):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in sets if top(i) == i}


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    vocabulary = [word() for _ in range(800)]
    texts = []
    for _ in range(40):  # contiguous changes
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        n = len(base)
        texts += [base, base + rng.choices(vocabulary, k=n * 18 // 100), base[: n - n * 18 // 100], base[: n - n * 9 // 100] + rng.choices(vocabulary, k=n * 9 // 100)]
    template = rng.choices(vocabulary, k=200)
    for _ in range(100):  # form letters, a copy of each
        letter = list(template)
        for at in range(10, 200, 32):
            letter[at] = word() + word()
        near = list(letter)
        near[rng.randrange(200)] = word()
        texts += [letter, near]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    got = {r.doc_id for r in near_deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == least_of_groups({i: shingle_set(t) for i, t in enumerate(texts)})


def test_long_texts_and_repeated_ids(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(5000)]
    long = rng.choices(vocabulary, k=40_000)
    other = list(long)
    for k in range(0, 40_000, 60):
        other[k] = "zz"
    rows = [(1, " ".join(long), 1), (2, " ".join(other), 1), (3, "one two three four five six", 1), (3, "another text of this id", 2), (4, "ANOTHER text of this id", 1), (5, "w " * 50_000, 1)]
    got = near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string, `_gone` int"))
    assert sorted((r.doc_id, r._gone) for r in got.collect()) == [(1, 1), (3, 1), (3, 2), (5, 1)]
    assert similar(shingle_set(rows[0][1]), shingle_set(rows[1][1]))


def test_the_bounds_of_batches_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdef", k=4)) for _ in range(400)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        texts += [base, base[:-1], base + ["end"], rng.choices(vocabulary, k=8) + base]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = least_of_groups({i: shingle_set(t) for i, t in enumerate(texts)})
    for held, listed, bucket in ((50, 10, 100), (10_000, 0, 10**6)):
        monkeypatch.setattr(near_dedup, "HELD", held)
        monkeypatch.setattr(near_dedup, "LISTED", listed)
        monkeypatch.setattr(near_dedup, "BUCKET", bucket)
        assert {r.doc_id for r in near_deduplicated(docs).collect()} == want


def test_shingles_are_counted_over_all_documents(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    lines = [" ".join(word() for _ in range(6)) for _ in range(700)]
    texts = [f"{lines[i % 700]} own{i} {lines[i * 7 % 503]}" for i in range(40_500)]
    near = []
    for i in range(30):  # in two documents each
        base = [word() for _ in range(60)]
        near += [len(texts) + 1]
        texts += [" ".join(base), " ".join([*base[:-1], f"end{i}"])]
    lists, prefixes = [], near_dedup._prefixes

    def seen(size, similarity, shift, common):
        lists.append(common.value)
        return prefixes(size, similarity, shift, common)

    monkeypatch.setattr(near_dedup, "_prefixes", seen)
    links = near_dedup.near_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    assert sorted((r.u, r.v) for r in links.distinct().collect()) == [(i, i - 1) for i in near]
    counts = Counter(h for t in texts for h in near_dedup.shingle_hashes(near_dedup.word_hashes(t), 5).tolist())
    ((keys, found),) = lists
    assert dict(zip(keys.tolist(), found.tolist(), strict=True)) == {h: n for h, n in counts.items() if n > 1}


def test_empty_table(spark):
    assert near_deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    now, kept = docs, dict(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == names, name
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(kept)
        if name == "exact_dedup":
            norm = [r.text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for r in rows]
            assert len(set(norm)) == len(norm)
            assert set(norm) == {r.text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for r in kept.values()}
        if name == "simhash_near_dedup":
            sets = {i: shingle_set(r.text) for i, r in kept.items()}
            pairs = [(i, j) for i in sets for j in sets if i < j and abs(len(sets[i]) - len(sets[j])) <= 0.25 * max(len(sets[i]), len(sets[j])) and similar(sets[i], sets[j])]
            linked = {i for p in pairs for i in p}
            assert not (set(kept) - set(after)) - linked
            caught = sum(not (i in after and j in after) for i, j in pairs)
            assert caught == len(pairs)
        if name == "pii":
            assert set(after) == set(kept)
        kept = after
        now = spark.createDataFrame(rows, out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]
