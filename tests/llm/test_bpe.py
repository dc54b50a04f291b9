"""Byte-level BPE against the library and against the merge definition; appends, edits and round trips."""

import gc
import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.bpe import Codec, codec, decode, encode, ids_digest, read_ranks
from quillspark.llm.queries import op6_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = codec(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode_packed(text), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode_packed(CODEC.encode_packed(text)) == text.encode()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aeiounrstlhéüñ ThE'", max_size=60))
def test_words(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_every_code_point_splits_alike():
    for cp in range(0, 0x110000, 7):
        if not 0xD800 <= cp < 0xE000:
            t = f"a{chr(cp)}1{chr(cp)} {chr(cp)}b!{chr(cp)}"
            assert ids(t) == LIBRARY.encode_ordinary(t), hex(cp)


def test_long_runs():
    for t in ("a" * 3000, "thereandback" * 300, " " * 5000, "é" * 2000, "abc" * 700 + " " + "!" * 900, "日本語" * 500):
        assert ids(t) == LIBRARY.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_tables_are_the_merges_of_each_prefix(data):
    p = CODEC.pieces
    last = p.table(data)
    for end in range(1, len(data) + 1):
        want = [p.ranks[x] for x in p.merged(data[:end])]
        assert p.tokens(data[:end], last[: end + 1]) == want


@settings(max_examples=200, deadline=None)
@given(st.text("thenadiou", max_size=120), st.text("thenadiou", max_size=9), st.integers(0, 120), st.integers(0, 9))
def test_appends_and_edits(text, by, start, cut):
    p, data = CODEC.pieces, text.encode()
    last = p.table(data)
    assert p.extended(data, last, by.encode()) == p.table(data + by.encode())
    start = min(start, len(data))
    new, table = p.edited(data, last, start, min(start + cut, len(data)), by.encode())
    assert table == p.table(new)


def test_digest(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "Hello, wörld! 12345", "x" * 5000, "\u0000\u001c\u0085", *["".join(rng.choices("abcdé \n'!1", k=80)) for _ in range(50)]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "again", "x")], "doc_id long, text string, ids string")
    rows = ids_digest(decode(encode(docs, PATH, PATTERN), PATH, PATTERN)).collect()
    assert len(rows) == len(texts) + 1
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    for i, t in enumerate(texts):
        want = np.array(LIBRARY.encode_ordinary(t or ""), "<u4")
        assert (i, len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in got
    assert encode(docs.limit(0).withColumn("x", F.lit(1)), PATH, PATTERN).count() == 0


def test_one_python_worker_a_task(spark):
    plan = op6_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_few_rows_are_read_and_handed_on_at_a_time(spark):
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(name) for name in names]
    try:
        for given, want in (((4096, 10000), (256, 500)), ((100, 0), (100, 500)), ((256, 40), (256, 40))):
            for name, value in zip(names, given, strict=True):
                spark.conf.set(name, str(value))
            op6_bpe(spark, "/root/testdata/sf0.001")
            assert tuple(int(spark.conf.get(name)) for name in names) == want
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def test_round_trip_is_decoding_what_was_encoded(spark):
    texts = [None, "", "Hello, wörld! 12345", "x" * 5000, "\u0000\u001c\u0085", "日本語 and more", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "again", "x")], "id long, body string, ids string")
    got = bpe.round_trip(docs, PATH, PATTERN, "id", "body")
    want = decode(encode(docs, PATH, PATTERN, "id", "body"), PATH, PATTERN)
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN, "id", "body").count() == 0


def held(c):
    """Bytes of a codec's tables with all that lies in them."""
    seen, todo, total = set(), [c.known, *vars(c.known).values(), *vars(c.pieces).values()], 0
    while todo:
        if id(x := todo.pop()) not in seen and isinstance(x, dict | list | tuple | set | str | bytes | int):
            seen.add(id(x))
            total += sys.getsizeof(x)
            todo += gc.get_referents(x) if isinstance(x, dict | list | tuple | set) else []
    return total


def test_tables_are_bounded_by_bytes_and_forgetting_changes_nothing(monkeypatch):
    for name in ("PIECES", "PREFIXES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 10_000)
    c, rng = Codec(PATH, PATTERN), random.Random(6)
    empty = held(c)
    for _ in range(20):
        t = " ".join("".join(rng.choices("thenadiouéü", k=rng.randrange(1, 9))) for _ in range(300))
        assert np.frombuffer(c.encode_packed(t), "<u4").tolist() == LIBRARY.encode_ordinary(t)
        c.pieces.halves.clear()  # an entry for each token at most
        assert held(c) - empty < 50_000


def test_a_match_of_many_bytes_is_not_remembered():
    c = Codec(PATH, PATTERN)
    t = "\U00010330" * 60
    assert np.frombuffer(c.encode_packed(t), "<u4").tolist() == LIBRARY.encode_ordinary(t)
    assert t not in c.known
