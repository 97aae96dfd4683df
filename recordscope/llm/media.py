"""ISO media containers: written around a payload, walked, and read without decoding.

``mux`` stores bytes losslessly as 8-bit audio samples of an ISO base media
file; ``probe`` walks its nested boxes, decodes the sample tables and gives
codec, duration and the byte ranges of the keyframes; ``payload_of`` follows
the sample tables to the stored bytes. All three take any such file with one
track; unknown boxes are skipped.

Media files are a column of a table in the shared folder; the features are
computed from what is read back from there.

Defined results: a null text is an empty one; an empty payload is stored as
64 zero bytes; equal texts give equal bytes; null keys are kept, and rows with
equal keys, repeated rows too, are rows of their own; texts of any length are
stored whole (a container above 4 GB has wide boxes); malformed containers
raise ValueError with the box at fault, as a silent skip would hide lost data;
an empty table gives no rows; columns other than the key and the text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize
from .tables import read, small, texts_of

#: Bytes of a sample, samples of a chunk, and samples from one keyframe to the next.
UNIT, CHUNK_SAMPLES, KEYFRAME_EVERY = 64, 64, 256
TIMESCALE = 8000
#: Boxes that hold boxes.
NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """Followed by bytes 0 up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def mux(payload: bytes, codec: bytes = b"raw ") -> bytes:
    """A file of one 8-bit mono track whose samples of UNIT bytes are the payload."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes")
    samples, duration = len(payload) // UNIT, len(payload)
    chunks = -(-samples // CHUNK_SAMPLES)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, min(CHUNK_SAMPLES, samples), 1)]
    if chunks > 1 and samples % CHUNK_SAMPLES:
        runs.append((chunks, samples % CHUNK_SAMPLES, 1))
    keys = range(1, samples + 1, KEYFRAME_EVERY)
    entry = _box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        starts = [first + k * CHUNK_SAMPLES * UNIT for k in range(chunks)]
        wide = starts[-1] >= 1 << 32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, samples, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, samples)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *starts)),
        )
        return _box(
            b"moov",
            _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IHHQ", 0x10000, 0x100, 0, 0), matrix, bytes(24), struct.pack(">I", 2), version=1),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3),
                _box(
                    b"mdia",
                    _full(b"mdhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">HH", 0x55C4, 0), version=1),
                    _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
                    _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
                ),
            ),
        )

    head = 16 if duration + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of the body, end of the body) of each box, nested ones after their parent."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"box header cut off at {start} in {path}")
        length, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if length == 1:
            length, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if length == 0 else start + length
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} has length {length}, beyond {end}")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


class Track:
    """The decoded sample tables of a file's only track."""

    def __init__(self, data: bytes):
        found = {path[-1]: (body, stop) for path, body, stop in walk(data)}
        missing = [k for k in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in found]
        if missing or not {b"stco", b"co64"} & found.keys():
            raise ValueError(f"boxes are missing: {missing or 'chunk offsets'}")
        at = found[b"mdhd"][0]
        self.timescale, self.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        self.codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
        at = found[b"stsz"][0] + 4
        fixed, self.samples = struct.unpack_from(">II", data, at)
        self.sizes = [fixed] * self.samples if fixed else list(struct.unpack_from(f">{self.samples}I", data, at + 8))
        at, width = (found[b"stco"][0], "I") if b"stco" in found else (found[b"co64"][0], "Q")
        (chunks,) = struct.unpack_from(">I", data, at + 4)
        self.chunks = struct.unpack_from(f">{chunks}{width}", data, at + 8)
        at = found[b"stsc"][0] + 4
        (n,) = struct.unpack_from(">I", data, at)
        runs = [struct.unpack_from(">III", data, at + 4 + 12 * k) for k in range(n)]
        firsts = [r[0] for r in runs]
        self.per_chunk = [runs[bisect_right(firsts, k + 1) - 1][1] for k in range(chunks)]
        at = found[b"stts"][0] + 4
        (n,) = struct.unpack_from(">I", data, at)
        self.times = [struct.unpack_from(">II", data, at + 4 + 8 * k) for k in range(n)]
        if b"stss" in found:
            at = found[b"stss"][0] + 4
            (n,) = struct.unpack_from(">I", data, at)
            self.keyframes = [k - 1 for k in struct.unpack_from(f">{n}I", data, at + 4)]
        else:
            self.keyframes = list(range(self.samples))
        self.offsets = []
        for start, count in zip(self.chunks, self.per_chunk, strict=True):
            for _ in range(count):
                self.offsets.append(start)
                start += self.sizes[len(self.offsets) - 1]
        if len(self.offsets) != self.samples or sum(n for n, _ in self.times) != self.samples:
            raise ValueError("the sample tables count different samples")

    def chunk_spans(self) -> list[tuple[int, int]]:
        spans, k = [], 0
        for start, count in zip(self.chunks, self.per_chunk, strict=True):
            spans.append((start, start + sum(self.sizes[k : k + count])))
            k += count
        return spans


def probe(data: bytes) -> dict:
    """Codec, timescale, duration, samples and keyframe byte ranges [start, end)."""
    t = Track(data)
    return {"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": t.samples, "keyframes": [[t.offsets[k], t.offsets[k] + t.sizes[k]] for k in t.keyframes]}


def payload_of(data: bytes) -> bytes:
    """The stored bytes, by the chunk and sample tables."""
    spans = Track(data).chunk_spans()
    if any(stop > len(data) for _, stop in spans):
        raise ValueError("a chunk reaches beyond the file")
    return b"".join(data[a:b] for a, b in spans)


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        raw = [x.encode() for x in texts_of(b)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def mux_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a media file."""
    return docs.select("doc_id", "text").mapInArrow(_mux_batches, "doc_id long, n_bytes long, media binary")


PROBED = {
    "codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "keyframes": pa.list_(pa.list_(pa.int64())), "payload_bytes": pa.int64(), "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
}


def _probe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for media in b["media"].to_pylist():
            info, payload = probe(media), payload_of(media)
            rows.append((info["codec"], info["timescale"], info["duration"], info["keyframes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(info, separators=(",", ":"))))
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(PROBED), PROBED.values())]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *columns], ["doc_id", "n_bytes", *PROBED])


def probe_media(media: DataFrame) -> DataFrame:
    """The columns of media files (doc_id, n_bytes, media), without the files."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_probe_batches, "doc_id long, n_bytes long, codec string, timescale long, duration long, keyframes array<array<long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(mux_texts(read(spark, sf_dir, "documents")), "media", compression="zstd")
    found = probe_media(stored)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
