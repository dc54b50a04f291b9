"""Quality: gradients by differences, passages by brute force, and held-out accuracy."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.logistic import sigmoid
from quillspark.llm.quality import N_FEATURES, PASSAGE, Model, _kinds, fit, passages, quality

def F_hash(spark, i):
    return spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0]


SF = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(1)
    x, bag, y = rng.normal(size=(9, N_FEATURES)), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model.p["b"][:] = 0.3

    def loss():
        p = sigmoid(model.forward(x, bag, 4)["logit"])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = model.gradient(model.forward(x, bag, 4), bag, y)
    for k, w in model.p.items():
        flat = w.reshape(-1)
        for i in range(0, len(flat), 7):
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            high = loss()
            flat[i] = keep - step
            low = loss()
            flat[i] = keep
            assert abs((high - low) / (2 * step) - grad[k].reshape(-1)[i]) < 1e-6, k


def test_attention_sums_to_one_and_passages_cover_texts():
    texts = ["", "one two", "x" * (PASSAGE * 3), "Wort " * 500, "a\n\nb", "é😀 " * 300]
    x, bag = passages(texts)
    assert [int((bag == i).sum()) for i in range(len(texts))] == [max(1, -(-len(t) // PASSAGE)) for t in texts]
    a = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES)).forward(x, bag, len(texts))["a"]
    assert np.allclose(np.bincount(bag, a), 1)
    for i, t in enumerate(texts):
        mine = x[bag == i]
        alone, _ = passages([t])
        assert np.allclose(mine, alone)
        if 0 < len(t) <= PASSAGE:
            assert mine[0, 8] == np.log1p(len(t.split())) and mine[0, 11] == len(set(t.split())) / len(t.split())


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality(docs.withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) >= 0.95


def plain_features(passage):
    """A passage's features by loops."""
    kind = [int(_kinds()[ord(c)]) for c in passage]
    share = [kind.count(k) / len(passage) for k in range(8)]
    words, now = [], ""
    for c, k in zip(passage + " ", [*kind, 4], strict=True):
        if k in (4, 5):
            words += [now] if now else []
            now = ""
        else:
            now += c
    w = max(1, len(words))
    mean = sum(map(len, words)) / w
    spread = max(0.0, sum(len(x) ** 2 for x in words) / w - mean**2) ** 0.5
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(any(_kinds()[ord(c)] == 7 for c in x) for x in words)
    shouted = sum(sum(_kinds()[ord(c)] == 2 for c in x) > 1 for x in words)
    return share + [math.log1p(len(words)), mean / 10, spread / 10, len(set(words)) / w, again / w, marked / w, shouted / w]


def plain_score(model, text):
    """The forward pass of one document, passage by passage."""
    text, p = text or " ", model.p
    weights, hidden = [], []
    for k in range(0, len(text), PASSAGE):
        x = [(f - m) / s for f, m, s in zip(plain_features(text[k : k + PASSAGE]), model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(x[i] * p["E"][i][j] for i in range(len(x))) + p["e"][j]) for j in range(len(p["e"]))]
        t = [math.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h)))) for j in range(len(h))]
        g = [1 / (1 + math.exp(-sum(h[i] * p["U"][i][j] for i in range(len(h))))) for j in range(len(h))]
        weights.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, p["w"], strict=True))))
        hidden.append(h)
    z = [sum(a * h[j] for a, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["b"][0])))


def test_the_query_matches_brute_force(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(90001, None), (90002, ""), (90003, "A A b-b\n\nÜÜ 12")]
    texts, known = dict(rows), {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    sample = sorted((F_hash(spark, i), i) for i in known if i in texts and zlib.crc32(str(i).encode()) % 4 != 2)
    model = fit([(texts[i] or "", known[i]) for _, i in sample])
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string"), labels.withColumn("text", F.lit("clash")).union(labels.withColumn("text", F.lit("again")))).collect()}
    for i, t in rows:
        want = plain_score(model, t)
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == (got[i].score >= 0.7), i


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "y " * 100000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality(docs, none).collect()} == {0.5}
    assert quality(docs.limit(0), none).count() == 0
    assert fit([("x", 1)]).score(["x", ""])[0] > 0.5
