"""Containers: round trips, foreign layouts, damaged input, and the digests by brute force."""

import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm.media import _box, _full, boxes, encode, media_columns, media_digest, padded, text_media, tracks


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 9), st.integers(1, 5))
def test_round_trip(data, chunk, key_every):
    payload = padded(data)
    media = encode(payload, chunk=chunk, key_every=key_every)
    (track,) = tracks(media)
    assert b"".join(media[a:b] for a, b in track.ranges) == payload
    units = len(payload) // 64
    first = media.index(b"mdat") + 4
    want = set(range(0, units, key_every))
    got = {k for a, b in track.keyframes for k in range((a - first) // 64, (b - first) // 64)}
    assert got == want and track.codec == "raw " and track.duration == len(payload) and track.samples == units


def test_box_walk_of_a_whole_container():
    names = ["/".join(k.decode() for k in p) for p, _, _ in boxes(encode(bytes(64)))]
    assert names[0] == "ftyp" and names[-1] == "mdat" and "moov/trak/mdia/minf/stbl/stss" in names


def test_variable_sizes_and_wide_offsets():
    sizes = [5, 7, 11, 3]
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(78))),
        _full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 20)),
        _full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)),
        _full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)),
        _full(b"co64", struct.pack(">I3Q", 3, 100, 200, 300)),
        _full(b"stss", struct.pack(">III", 2, 1, 4)),
    )
    media = _box(b"moov", _box(b"trak", _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), _box(b"minf", table))))
    (track,) = tracks(media)
    assert (track.codec, track.timescale, track.duration, track.samples) == ("avc1", 1000, 50, 4)
    assert track.ranges == [(100, 112), (200, 211), (300, 303)]
    assert track.keyframes == [(100, 105), (300, 303)]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 2000))
def test_damaged_containers_do_not_fail(noise, at):
    media = encode(bytes(640))
    tracks(noise)
    tracks(media[: at % len(media)])
    tracks(media[: at % len(media)] + noise + media[at % len(media) :])


def test_digest(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (5, "x" * 64), (1, "abc"), (None, "y" * 200000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, media string").withColumn("codec", F.lit(1))
    rows = sorted(media_digest(media_columns(text_media(docs))).collect(), key=str)
    want = sorted(texts, key=lambda x: str(x[0]))
    assert len(rows) == len(texts)
    by = {(r.doc_id, r.payload_sha256): r for r in rows}
    for i, t in want:
        data = (t or "").encode()
        p = padded(data)
        r = by[i, hashlib.sha256(p).hexdigest()]
        media = encode(p)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(p), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert media_columns(spark.createDataFrame([(b"",), (None,), (b"junk",)], "media binary")).where("codec is null and size(keyframes) = 0").count() == 3
    assert media_digest(media_columns(text_media(docs.limit(0)))).count() == 0


def test_digest_of_null_and_damaged_containers(spark):
    rows = [(1, 0, None), (2, 3, b""), (3, 5, b"\x00\x00\x00\x08free"), (4, 1, b"\xff" * 40)]
    described = media_columns(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary"))
    got = {r.doc_id: r for r in media_digest(described).collect()}
    assert len(got) == 4 and all(r.payload_bytes == 0 and r.feature.startswith("codec=;") for r in got.values())
    assert [got[i].media_bytes for i in (1, 2, 3, 4)] == [0, 0, 8, 40]
