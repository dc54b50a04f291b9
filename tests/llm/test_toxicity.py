"""Toxicity: the automaton against edit distances, context weights, and accuracy on held-out rows."""

import math
import random
import zlib

from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.toxicity import DISGUISES, WORD, FuzzyTrie, allowed_edits, context_weight, fit, fitted_model, not_toxic, score_documents, toxicity

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(4)
    terms = ["zeit", "idiot", "moron", "scum", "worthless", "disgusting", "pathetic", "trash", "trashes"]
    trie = FuzzyTrie(dict.fromkeys(terms, 1.0))
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            if kind == 0:
                w.insert(at, rng.choice("aeioustz"))
            elif w and kind == 1:
                del w[min(at, len(w) - 1)]
            elif w:
                w[min(at, len(w) - 1)] = rng.choice("aeioustz")
        w = "".join(w)
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= allowed_edits(len(t)))
        assert trie.match(w) == ((near[0][1], near[0][0]) if near else None), w


def test_context_weighs_hits():
    weight = lambda t: context_weight(t, t.index("idiot"), t.index("idiot") + 5)
    assert weight("such an idiot here") == 1.0
    assert weight("you idiot") == 1.25
    assert weight('he said "what an idiot" then') == 0.25
    assert weight("they wrote idiot there") == 0.25
    assert weight("«un idiot» alors") == 0.25


def test_held_out_accuracy_and_shape(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity(docs.withColumn("score", F.lit("clash")), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) >= 0.9


def test_filter_keeps_clean_rows(spark):
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(100)], "doc_id long, toxic int")
    texts = [(i, ("you are an idiot and stupid" if i < 30 else "the weather is fine") + f" nr{'abcdefghij'[i % 10]}", "x") for i in range(100)]
    docs = spark.createDataFrame([*texts, (100, None, None), (101, "", "x")], "doc_id long, text string, score string")
    kept = not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30, 102))


def brute_hit(model, word):
    """One word against the whole lexicon, entry by entry."""
    stem = lambda w: next((w[:k] for k in range(3, min(8, len(w) - 1) + 1) if w[:k] in model.stems), None)
    if word in model.words:
        return 0, model.words[word]
    if stem(word):
        return 1, model.stems[stem(word)]
    if word in model.harmless:
        return None
    plain = word.translate(DISGUISES) if not word.isalpha() and any(c.isalpha() for c in word) else word
    if plain != word and plain in model.words:
        return 2, model.words[plain]
    if plain != word and stem(plain):
        return 1, model.stems[stem(plain)]
    near = sorted((d, t) for t in model.fuzzy if abs(len(t) - len(plain)) <= 2 and (d := distance(plain, t)) <= allowed_edits(len(t)))
    return (2 if near[0][1] in model.words else 1, model.fuzzy[near[0][1]] / (1 + near[0][0])) if near and len(word) >= 3 else None


def brute_score(model, text, known):
    low = text.lower()
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(low)]
    for w in {w for _, _, w in words} - known.keys():
        known[w] = brute_hit(model, w)
    sums, kinds = [0.0] * 3, [set(), set(), set()]
    for s, e, w in words:
        if known[w]:
            sums[known[w][0]] += known[w][1] * context_weight(low, s, e)
            kinds[known[w][0]].add(w)
    x = [*(math.log1p(v) for v in sums), *(v / math.sqrt(len(words) + 20) for v in sums), *(math.log1p(len(k)) for k in kinds)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1])))


def test_the_query_matches_brute_force(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = [(r.doc_id, r.text) for r in docs.limit(150).collect()] + [(90001, None), (90002, ""), (90003, "such an 1d1ot, you stupyd m0rons"), (90004, "scom and trsh")]
    model = fitted_model(docs, labels)
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    known = {}
    for i, t in rows:
        assert abs(got[i].score - brute_score(model, t or "", known)) < 1e-9, i
    twice = labels.withColumn("text", F.lit("clash")).unionByName(labels.withColumn("text", F.lit("again"))).union(spark.createDataFrame([(None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string").select(*labels.columns, "text"))
    assert fitted_model(docs, twice).words == model.words


def test_misspelled_and_disguised_words_of_stems_are_found():
    forms = ["grumbling", "grumbled", "grumbler", "grumbles"]
    sample = [(f"you {forms[i % 4]} person number {'abcdefgh'[i % 8] * 3}", 1) for i in range(80)] + [(f"you fine {'abcdefgh'[i % 8] * 3} person number {i}", 0) for i in range(300)]
    model = fit(sample)
    assert any("grumbling".startswith(s) for s in model.stems) or set(forms) <= set(model.words)
    for word in ("grumbling", "grumblimg", "grumb1ed", "grummbler", "grombles"):
        assert model.score(f"you {word} person") > 0.5, word
    assert model.score("you crumbs person") < 0.5 and model.score("you fine person") < 0.5


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.doc_id, round(r.score, 6), r.predicted) for r in toxicity(docs, none).collect()] == [(1, 0.5, 1)] * 2
    assert toxicity(docs.limit(0), none).count() == 0
    assert fit([("x", 0)]).score("anything") < 0.5
