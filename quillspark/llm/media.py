"""Media columns: ISO base media containers, read without decoding payloads.

``media_columns`` walks the nested boxes of a container, decodes the sample tables (``stsd stts stsc stsz
stco co64 stss``) and gives codec, duration and the byte ranges of the keyframes' runs. ``encode`` stores a
payload losslessly as 8-bit samples in such a container. Both are row by row, in Arrow batches; nothing
is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"])
FRAME, RATE, CHUNK, KEY_EVERY = 64, 8000, 256, 32


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def encode(payload: bytes, frame: int = FRAME, rate: int = RATE, chunk: int = CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """An ISO container with one audio track of unsigned 8-bit samples, ``frame`` of them an access unit.

    The payload's length is a positive multiple of ``frame``. Every ``key_every``-th unit is marked as a
    keyframe. The same payload gives the same bytes.
    """
    if not payload or len(payload) % frame:
        raise ValueError(f"the payload's length must be a positive multiple of {frame}")
    units = len(payload) // frame
    chunks = -(-units // chunk)
    last = units - (chunks - 1) * chunk
    duration = len(payload)

    def movie(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        runs = [(1, chunk, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != chunk)
        keys = range(1, units + 1, key_every)
        offsets = [first + k * chunk * frame for k in range(chunks)]
        wide = first + len(payload) > 0xFFFFFFFF
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, frame)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", frame, units)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, duration, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQII Q8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, rate, duration, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1), track)

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = 16 if len(payload) + 8 > 0xFFFFFFFF else 8
    first = len(kind) + len(movie(0)) + head
    return kind + movie(first) + _box(b"mdat", payload)


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """``(path, body start, body end)`` of every box, nested ones after their container.

    Stops at a box whose size doesn't fit; size 0 reaches to the end, size 1 is followed by 64 bits.
    """
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", data, start + 8)
            body += 8
        size = size or end - start
        if size < body - start or start + size > end:
            return
        here = (*path, bytes(kind))
        yield here, body, start + size
        if kind in CONTAINERS:
            yield from boxes(data, body, start + size, here)
        start += size


@dataclass
class Track:
    """What the sample tables of one track say."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    #: (first sample's byte, last sample's end) of each sample, by run of samples that lie together.
    ranges: list[tuple[int, int]] | None = None
    #: Byte ranges of the keyframes, neighbours merged.
    keyframes: list[tuple[int, int]] | None = None
    samples: int = 0


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container; a track without usable tables has empty ranges. No payload is decoded."""
    found: list[Track] = []
    tables: dict[bytes, tuple[int, int]] = {}

    def close() -> None:
        if found and tables:
            _tables(data, tables, found[-1])
        tables.clear()

    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            close()
            found.append(Track(ranges=[], keyframes=[]))
        elif found and kind == b"mdhd" and b - a >= 4:
            wide = data[a] == 1
            if b - a >= (32 if wide else 20):
                found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif found and b"stbl" in path[:-1]:
            tables[kind] = (a, b)
    close()
    return found


def _entries(data: bytes, span: tuple[int, int] | None, form: str, skip: int = 4) -> list[tuple]:
    """The rows of a table box, as many as it has room for."""
    if span is None or span[1] - span[0] < skip + 4:
        return []
    (n,) = struct.unpack_from(">I", data, span[0] + skip)
    n = min(n, (span[1] - span[0] - skip - 4) // struct.calcsize(form))
    at = span[0] + skip + 4
    return list(struct.iter_unpack(form, data[at : at + n * struct.calcsize(form)]))


def _tables(data: bytes, tables: dict[bytes, tuple[int, int]], track: Track) -> None:
    if (d := tables.get(b"stsd")) and d[1] - d[0] >= 16:
        track.codec = data[d[0] + 12 : d[0] + 16].decode("latin-1")
    offsets = [o for (o,) in (_entries(data, tables.get(b"co64"), ">Q") or _entries(data, tables.get(b"stco"), ">I"))]
    runs = _entries(data, tables.get(b"stsc"), ">III")
    fixed, sizes, count = 0, [], 0
    if (z := tables.get(b"stsz")) and z[1] - z[0] >= 12:
        fixed, count = struct.unpack_from(">II", data, z[0] + 4)
        sizes = [] if fixed else [n for (n,) in _entries(data, z, ">I", skip=8)]
        count = count if fixed else len(sizes)
    if not track.duration:
        track.duration = sum(n * d for n, d in _entries(data, tables.get(b"stts"), ">II"))
    keys = {k for (k,) in _entries(data, tables.get(b"stss"), ">I")}
    every = b"stss" not in tables  # then each sample is a keyframe
    sample, run = 0, 0
    for number, offset in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        if not runs or sample >= count:
            break
        n, at = min(runs[run][1], count - sample), offset
        if fixed and n:
            _extend(track.ranges, at, at + n * fixed)
            inside = range(sample + 1, sample + n + 1) if every or len(keys) > n else ()
            for k in inside or sorted(k for k in keys if sample < k <= sample + n):
                if every or k in keys:
                    _extend(track.keyframes, at + (k - sample - 1) * fixed, at + (k - sample) * fixed)
        else:
            for k in range(sample, sample + n):
                _extend(track.ranges, at, at + sizes[k])
                if every or k + 1 in keys:
                    _extend(track.keyframes, at, at + sizes[k])
                at += sizes[k]
        sample += n
    track.samples = sample


def _extend(ranges: list[tuple[int, int]], start: int, end: int) -> None:
    if ranges and ranges[-1][1] == start:
        ranges[-1] = (ranges[-1][0], end)
    else:
        ranges.append((start, end))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # a few texts at a time, for a container is as long as its text
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            data = [(t.as_py() or "").encode("utf-8") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([encode(padded(d)) for d in data], pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a container.

    Null counts as empty. Equal texts give equal bytes. Extra columns are ignored; rows may repeat.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


_COLUMNS = "codec string, timescale long, duration long, duration_s double, samples long, payload array<struct<start:long,end:long>>, keyframes array<struct<start:long,end:long>>"


def _described(batches: Iterator[pa.RecordBatch], at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(at):
            track = next(iter(tracks(value.as_py() or b"")), None) or Track("", 0, 0, [], [])
            seconds = track.duration / track.timescale if track.timescale else None
            spans = [[{"start": a, "end": b} for a, b in r] for r in (track.ranges, track.keyframes)]
            rows.append((track.codec or None, track.timescale, track.duration, seconds, track.samples, *spans))
        own = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[-7:], strict=True)] if rows else [pa.array([], f.type) for f in list(schema)[-7:]]
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *[f.name for f in list(schema)[-7:]]])


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` plus codec, timescale, duration, duration_s, samples, payload and keyframes of the container's first track.

    Byte ranges are ends exclusive, neighbours merged. Null, empty and damaged containers give null codec
    and empty ranges. The columns must not be there already.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(_COLUMNS)
    if clash := {f.name for f in added} & set(df.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    at, schema = df.columns.index(media), StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)
    return df.mapInArrow(lambda b: _described(b, at, arrow), schema)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            media = r["media"] or b""
            payload = b"".join(media[s["start"] : s["end"]] for s in r["payload"] or [])
            frames = r["keyframes"] or []
            keys = ",".join(f"{s['start']}-{s['end']}" for s in frames[:1] + frames[-1:])
            every = hashlib.sha256(",".join(f"{s['start']}-{s['end']}" for s in frames).encode()).hexdigest()[:16]
            feature = f"codec={(r['codec'] or '').strip()};rate={r['timescale']};duration={r['duration']};samples={r['samples']};keyframes={len(frames)};first,last={keys};ranges={every}"
            rows.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_DIGEST.replace(" long", "").replace(" string", "").split(", "))


def media_digest(described: DataFrame) -> DataFrame:
    """The contract's columns, from the bytes of :func:`text_media` as :func:`media_columns` located them.

    A null or damaged container has an empty payload and no codec.
    """
    return described.mapInArrow(_digested, _DIGEST)
