"""Language identification: n-grams by brute force, held-out accuracy, and defined results for odd texts."""

import math
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.language import BUCKETS, Model, identify, ngrams, predict

SF = "/root/testdata/sf0.01"


def brute(text):
    """Numbers of n-grams by size: of the text's letters with a single space around and between their runs."""
    if not any(c.isalpha() for c in text):
        return [0, 0, 0]
    low = f" {text.lower()} "
    s = " ".join(["", *"".join(c if c.isalpha() else " " for c in low).split(), ""])
    return [max(0, len(s) - n + 1) for n in (1, 2, 3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=6))
def test_ngrams_stay_within_texts(texts):
    together = [Counter(o.tolist()) for o, _ in ngrams(texts)] + [Counter()] * 3
    for i, t in enumerate(texts):
        assert [together[n][i] for n in range(3)] == brute(t)
    alone = [sorted(b.tolist()) for o, b in ngrams(texts[-1:])]
    last = [sorted(b[o == len(texts) - 1].tolist()) for o, b in ngrams(texts)]
    assert [x for x in alone if x] == [x for x in last if x] and all(0 <= b < BUCKETS for x in alone for b in x)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify(docs.withColumn("score", F.lit("clash"))).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.97


def buckets(text):
    """The buckets of a text's n-grams, one n-gram after another, in plain integers."""
    if not any(c.isalpha() for c in text):
        return []
    s = " ".join(["", *"".join(c if c.isalpha() else " " for c in f" {text.lower()} ").split(), ""])
    out, cut = [], (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            value = 0
            for c in s[i : i + n]:
                value = (value * 0x9E3779B97F4A7C15 + ord(c) + 1) & cut
            out.append(((((value ^ (value >> 29)) * 0xBF58476D1CE4E5B9) & cut) >> 40) % BUCKETS)
    return out


def brute_identify(rows):
    """Naive Bayes by dictionaries: ``rows`` of (doc_id, text, lang)."""
    counts, docs = {}, Counter()
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(buckets(t or ""))
    out = {}
    for i, t, _ in rows:
        found = buckets(t or "")
        if not found or not docs:
            out[i] = ("und", 0.0)
            continue
        total = {}
        for lang in sorted(docs):
            whole = sum(counts[lang].values()) + 0.5 * BUCKETS
            total[lang] = math.log((docs[lang] + 1) / (sum(docs.values()) + len(docs))) + sum(n * math.log((counts[lang][b] + 0.5) / whole) for b, n in Counter(found).items())
        best = max(sorted(total), key=total.get)
        out[i] = (best, 1 / sum(math.exp(max(-700, x - total[best])) for x in total.values()))
    return out


def test_the_query_matches_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()] + [(90001, None, "en"), (90002, "", "de"), (90003, "x", None), (90004, "ß Ünï 12", "xx")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, (lang, score) in brute_identify(rows).items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, i


def test_hundreds_of_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i)} word", f"l{i:03d}") for i in range(600)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), modulus=1, held_out=5).collect()
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in got) and len(got) == 600


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, "der die das", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "", None), (5, "12 !?", "de"), (6, "the of", None), (6, "das die " * 20000, None), (None, "the", None)], "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in identify(docs, modulus=1, held_out=5).collect())
    assert got == [("1", "de"), ("2", "en"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "de"), ("6", "en"), ("None", "en")]
    nothing = predict(docs, Model([])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert identify(docs.limit(0)).count() == 0
