"""WARC archives: written, normalised from monolithic gzip streams, and read back by offset.

``write_archives`` puts records into archive files, each one gzip stream over
the whole file, as careless tools make them. ``normalise`` inflates each
stream once, piece by piece, rewrites every record as a gzip member of its
own, and writes a sidecar index of member offsets beside it, so that any
record can be read alone. ``read_records`` reads by that index. At no time is
more than a record and a few pieces of an archive in memory.

Files go to a folder that driver and executors share, by any URI that pyarrow
opens. A task's attempt has its own file names, and only archives named in the
table that the committed attempts return count, so lost executors leave
unused files at worst.

Defined results: a null payload is an empty one; payloads of at least
LEAST_SHARED bytes that are equal have one response, that with the smallest
page_id, and rows with that very id are responses too; rows with a null id in
a group with ids revisit it, in a group without ids all are responses;
repeated rows are records of their own; payloads of any length are written
whole; null urls leave out the target; records cut off or of a wrong length
raise ValueError; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import NativeFile
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, maybe_member, salted_lookup
from ..storage import materialize, new_folder
from .tables import read, small

#: Shorter payloads are never revisits.
LEAST_SHARED = 100
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Compressed and inflated bytes that are handled at a time, and rows of the index.
PIECE_BYTES, INFLATED_BYTES, INDEX_ROWS = 64 << 10, 1 << 20, 10_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def with_targets(pages: DataFrame) -> DataFrame:
    """Adds payload (binary), digest and refers_to: the page that holds an equal payload's response, for revisits.

    Only payloads that surely or maybe have copies, by a bitmap of bounded size, are joined.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED)
    groups = shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    groups = materialize(groups, "copies")
    hot = hot_keys(groups, "digest", "copies", pages.count())
    marked = maybe_member(rows, "digest", groups, "copied")
    alone = marked.where("NOT copied").drop("copied").withColumn("first", F.lit(None).cast("long"))
    joined = salted_lookup(marked.where("copied").drop("copied"), groups.select("digest", "first"), "digest", hot, F.xxhash64("page_id", "url"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return alone.unionByName(joined).select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def _name(page: int | None) -> str:
    return URN + ("" if page is None else str(page))


def _page(name: str | None) -> int | None:
    return int(name[len(URN) :]) if name and len(name) > len(URN) else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit's block has the headers only; the full payload's length goes with it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(page)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_name(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n")
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], int, int, int]:
    """Headers (lower-case names), start and end of the block, and end of the record that starts at ``at``."""
    data = bytes(data) if isinstance(data, memoryview) else data
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not data.startswith(b"WARC/", at):
        raise ValueError(f"no record starts at {at}")
    first = data.index(b"\r\n", at) + 2
    headers = {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, v in _HEADER.findall(data[first : stop + 2])}
    start = stop + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off or has a wrong length")
    return headers, start, end, end + 4


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _place(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder's URI or absolute path, and the path there."""
    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return fs, path


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(archive, records): the written table of the archive files in folder, each one gzip stream over many records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (fs, path), task, number, out = _place(folder), TaskContext.get(), 0, None
        for b in small(batches):
            for page, url, payload, digest, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:06d}.warc.gz"
                    out, packer, size, records, number = fs.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0, number + 1
                raw = record(page, url, payload, digest, refers_to)
                out.write(packer.compress(raw))
                size, records = size + len(raw), records + 1
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records]})

    return materialize(rows.mapInArrow(run, "archive string, records long"), "archives")


def pieces(file: NativeFile) -> Iterator[bytes]:
    while piece := file.read(PIECE_BYTES):
        yield piece


def inflate(packed: Iterable[bytes]) -> Iterator[bytes]:
    """The content of gzip members, one after the other, in pieces of bounded size; one that is cut off raises ValueError."""
    unpack = None
    for chunk in packed:
        while chunk:
            if unpack is None:
                unpack = zlib.decompressobj(31)
            data = unpack.decompress(chunk, INFLATED_BYTES)
            while data:
                yield data
                # What is left of the chunk, or of the output of a chunk that is used up.
                data = unpack.decompress(unpack.unconsumed_tail, INFLATED_BYTES) if not unpack.eof else b""
            chunk = unpack.unconsumed_tail
            if unpack.eof:  # tools that flush now and then make several streams
                chunk, unpack = unpack.unused_data, None
    if unpack is not None:
        raise ValueError("the gzip stream is cut off")


def records_of(raw: Iterable[bytes]) -> Iterator[bytes]:
    """The whole records of uncompressed pieces."""
    held, at = bytearray(), 0
    for piece in raw:
        held += piece
        while True:
            stop = held.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            length = _LENGTH.search(held, at, stop + 2)
            if length is None or not held.startswith(b"WARC/", at):
                raise ValueError("no record starts where one should")
            end = stop + 4 + int(length[1]) + 4
            if end > len(held):
                break
            yield bytes(held[at:end])
            at = end
        if at >= INFLATED_BYTES or at == len(held):
            del held[:at]
            at = 0
    if len(held) > at:
        raise ValueError("a record is cut off")


def members(packed: Iterable[bytes]) -> Iterator[bytes]:
    """Each record of a gzip stream, checked, as a gzip member of its own."""
    for raw in records_of(inflate(packed)):
        if parse(raw)[3] != len(raw):
            raise ValueError("a record has a wrong length")
        yield _gzip(raw)


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """(archive, offset, length): the written table of all members. Each archive of source becomes a file in folder with a member per record, and a sidecar index as JSON lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (here, there), (fs, path), attempt = _place(source), _place(folder), TaskContext.get().taskAttemptId()
        for b in batches:
            for archive in b["archive"].to_pylist():
                name, offsets, lengths, at = f"{archive.removesuffix('.warc.gz')}-{attempt}.warc.gz", [], [], 0
                with here.open_input_stream(f"{there}/{archive}", compression=None) as file, fs.open_output_stream(f"{path}/{name}", compression=None) as out, fs.open_output_stream(f"{path}/{name}.idx.jsonl", compression=None) as sidecar:
                    for member in members(pieces(file)):
                        out.write(member)
                        sidecar.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                        if len(offsets) == INDEX_ROWS:
                            yield pa.RecordBatch.from_pydict({"archive": [name] * len(offsets), "offset": offsets, "length": lengths})
                            offsets, lengths = [], []
                if offsets:
                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(offsets), "offset": offsets, "length": lengths})

    return materialize(archives.mapInArrow(run, "archive string, offset long, length long"), "members")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row per record, each member read alone by its offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, path), opened, file = _place(folder), None, None
        for b in small(batches):
            rows = []
            for archive, offset, length in zip(b["archive"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist()):
                if archive != opened:
                    if file is not None:
                        file.close()
                    opened, file = archive, fs.open_input_file(f"{path}/{archive}")
                file.seek(offset)
                rows.append(_record_row(zlib.decompress(file.read(length), 31)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    return index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _record_row(raw: bytes) -> tuple:
    headers, start, end, stop = parse(raw)
    if stop != len(raw):
        raise ValueError("a member holds more than one record")
    http, _, payload = raw[start:end].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} is not the one written")
    return _page(headers["warc-record-id"].strip("<>")), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to", "").strip("<>"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    monolithic, normal = new_folder(spark, "warc-monolithic"), new_folder(spark, "warc-normalised")
    archives = write_archives(with_targets(read(spark, sf_dir, "pages")), monolithic)
    return read_records(normalise(archives, monolithic, normal), normal)


OP10_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {LEAST_SHARED} GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
 CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= {LEAST_SHARED}"""
