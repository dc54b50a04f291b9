"""Packing: exact round trip, capacity, gapless offsets, little padding, and the ids of the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm.packing import balanced, encoder, pack, pieces_digest

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


LIBRARY = library()


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_the_librarys(text):
    assert encoder(PATH)(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_long_runs():
    for text in (" " * 20000, "a" * 20000, "<|endoftext|>", "é" * 5000, "\n \t" * 3000 + "x", "!?" * 9000):
        assert encoder(PATH)(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_windows_hold_each_part_once(parts):
    bins = balanced(parts, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(parts)))
    assert all(0 < sum(parts[i] for i in b) <= 50 for b in bins)


def test_windows_are_near_equal():
    rng = random.Random(1)
    parts = [rng.randint(1, 512) for _ in range(1000)]
    sums = [sum(parts[i] for i in b) for b in balanced(parts, 2048)]
    assert max(sums) - min(sums) <= 16
    with pytest.raises(ValueError):
        balanced([51], 50)


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "béta", "gamma\n", "δ", "12345"], k=rng.choice([1, 30, 900, 9000]))) for _ in range(120)] + [None, "", "x" * 40000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(5, "again", "clash")], "doc_id long, text string, ids string").repartition(3)
    rows = pack(docs, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        if i != 5:
            got = sorted(by_doc[i], key=lambda r: r.start)
            assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1])
            ids = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4").tolist()
            assert ids == [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
            assert {r.doc_tokens for r in got} == {len(ids)}
    assert len({r.doc_tokens for r in by_doc[5]}) == 2
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
        assert sum(r.length for r in pieces) <= 2048
    total = sum(r.length for r in rows)
    assert total / (2048 * len(by_sequence)) > 0.97
    crc = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in pieces_digest(pack(docs, PATH)).collect()}
    assert all(crc[r.doc_id, r.start, r.length] == zlib.crc32(bytes(r.ids)) for r in rows if r.doc_id != 5)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
