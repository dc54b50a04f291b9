"""The queries of the contract over whole small tables, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

from quillspark.llm.common import table
from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_bpe import LIBRARY as BPE
from tests.llm.test_packing import LIBRARY as PACKING
from tests.llm.test_pii import base
from tests.llm.test_simhash import brute
from verify import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = run(spark, "op1_pii")
    assert len(got) == len(texts)
    names = ("email", "ip", "card", "phone")
    for r in got:
        want = [f"{names[k]}:{s}:{e}" for s, k, e, _ in base(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(n + ":") for w in want) for n in names]


def test_op2(spark):
    talks = defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role, r.text or ""))
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in run(spark, "op2_chat")}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        replies = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())


def test_op3(spark, texts):
    got, spans = defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_packing"):
        got[r.doc_id].append(r)
        spans[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*PACKING.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    padding = 1 - sum(n for p in spans.values() for _, n in p) / (2048 * len(spans))
    assert padding < 0.01


def test_op4(spark, texts):
    prints = brute(texts.items())
    values = np.array([prints[i] for i in sorted(prints)], dtype=np.uint64)
    ids = sorted(prints)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 4) for v in values]
    changed = True
    while changed:
        low = np.array([label[n].min() for n in near])
        changed = bool((low != label).any())
        label = low
    want = {(i, f"{prints[i]:016x}", ids[label[k]]) for k, i in enumerate(ids)}
    assert {tuple(r) for r in run(spark, "op4_simhash")} == want


def test_op5(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op5_media")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op6(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op6_bpe")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = np.array(BPE.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    other = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in other.description]
    df = QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == rows(columns, other.fetchall())


def test_nothing_reads_less_than_the_table():
    source = "".join(p.read_text() for p in Path(__file__).parents[2].glob("quillspark/llm/queries.py"))
    assert not re.search(r"\.limit\(|\.sample\(|\.where\(|\.filter\(", source)
    assert xxhash.xxh64_intdigest(b"", 42) == 0x98B1582B0977E704
