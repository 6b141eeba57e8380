"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES. A bundle
ends with a seek table in a skippable frame (the public seekable format), so a reader
finds any frame from the last bytes and decompresses nothing else. The index maps a
record's id to its bundle, its frame, and its offset and length in the frame's content.

Bundles are rows of a Parquet table in the shared folder, each with the index of its
records. Spark's committer writes it, so a retried task leaves no half bundle, and any
store that Spark reaches will do. `read` goes through the index, `fetch` reads single
records by id, and `rebuilt` makes the index anew from archives alone. `export` writes
bundles as plain files where the folder is local.

Of records with equal payloads of at least `min_revisit_bytes`, the one with the
smallest id is a response and the others revisit it.

Defined cases: a null payload is empty; a null id is never the smallest, and in a
group with null ids alone all are responses; of repeated rows with the smallest
id each is a response; the null id is read back as null; an empty table gives an
empty one; other columns are ignored. Repeated ids share a record id in their headers, but each
has its own place in the index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, per_batch, table

#: A bundle is closed at the first frame that takes it past this, or past 16 times as much content. One record is never split.
BUNDLE_BYTES = 8 << 20
#: A frame is closed at the first record that takes its content past this.
FRAME_BYTES = 256 << 10
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2026-01-01T00:00:00Z"
_PLACE = "page_id: long, frame: int, offset: long, length: long"
BUNDLES = f"bundle string, archive binary, places array<struct<{_PLACE}>>"
_PLACES = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
#: Where digests that occur twice are too many to be broadcast, each meets its rows in so many parts.
SALTS = 16
BROADCAST_DIGESTS = 1_000_000
_HEAD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NO_ID = "none"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(key: int | None) -> str:
    return f"<urn:page:{_NO_ID if key is None else key}>"


def _key(uri: str) -> int | None:
    text = uri[len("<urn:page:") : -1]
    return None if text == _NO_ID else int(text)


def record(key: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has no payload but that of its headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = "".join(c for c in url or "about:blank" if c > " " and c != "\x7f")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return headers, http, payload


class Bundle:
    """Frames of a bundle as they are written, and the places of its records."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.places: list[tuple[int | None, int, int, int]] = []
        self.bytes = self.content = self.pending = 0
        self.open: list[bytes] = []

    def add(self, key: int | None, data: bytes) -> None:
        self.places.append((key, len(self.frames), self.pending, len(data)))
        self.open.append(data)
        self.pending += len(data)
        if self.pending >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.pending))
            self.bytes += len(frame)
            self.content += self.pending
            self.open, self.pending = [], 0

    def close(self) -> bytes:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(entries) + len(foot)), entries, foot])


def seek_table(data: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(offset, length, content length) of each frame, from the end of the bundle."""
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    step = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or struct.unpack_from("<I", data, len(data) - 17 - n * step)[0] != SKIPPABLE:
        raise ValueError("no seek table")
    found, at, first = [], 0, len(data) - 9 - n * step
    for k in range(n):
        size, content = struct.unpack_from("<II", data, first + k * step)
        found.append((at, size, content))
        at += size
    if at != first - 8:
        raise ValueError("the seek table doesn't match the frames")
    return found


class Archive:
    """Frames of a bundle, each decompressed when a record of it is asked for; the latest is kept."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.frames, self.zstd = memoryview(data), seek_table(data), zstandard.ZstdDecompressor()
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            at, size, content = self.frames[k]
            self.held = k, self.zstd.decompress(self.data[at : at + size], max_output_size=content)
        return self.held[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        data = self.frame(frame)[offset : offset + length]
        if len(data) != length:
            raise ValueError("a place lies beyond its frame")
        return data

    def scan(self) -> Iterator[tuple[int, int, bytes]]:
        """Frame, offset and bytes of every record, found without an index from the lengths in the headers."""
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                body = data.index(b"\r\n\r\n", at) + 4
                length = next(int(x[16:]) for x in data[at:body].split(b"\r\n") if x.startswith(b"Content-Length: "))
                yield k, at, data[at : body + length + 4]
                at = body + length + 4


def _table(rows: list[tuple], ddl: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])


def _bundles(bundle_bytes: int, frame_bytes: int):
    def closed(bundle: Bundle) -> pa.RecordBatch:
        data = bundle.close()
        places = [dict(zip(("page_id", "frame", "offset", "length"), p, strict=True)) for p in bundle.places]
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()], pa.string()), pa.array([data], pa.binary()), pa.array([places], _PLACES)], names=["bundle", "archive", "places"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bundle(frame_bytes)
        for batch in batches:
            for key, url, body, refers, revisit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                held.add(key, record(key, url, data, digest(data), refers, revisit))
                if held.bytes >= bundle_bytes or held.content >= 16 * bundle_bytes:
                    yield closed(held)
                    held = Bundle(frame_bytes)
        if held.places:
            yield closed(held)

    return run


def write(pages: DataFrame, payload: str = "html", min_revisit_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """The bundles of pages (page_id, url, payload), as written in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(payload).alias("_payload")).withColumn("_body", F.coalesce(F.col("_payload"), F.lit("")).cast("binary"))
    rows = rows.withColumn("_sha", F.when(F.octet_length("_body") >= min_revisit_bytes, F.sha1("_body"))).drop("_body")
    # Only payloads that occur twice are joined back, so this side has no row for most pages and one for a hot payload.
    twice = rows.where(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL").drop("_n")
    twice = materialise(twice, "warc-digests")
    if twice.limit(broadcast_digests + 1).count() <= broadcast_digests:
        joined = rows.join(F.broadcast(twice), "_sha", "left")  # no payload moves
    else:
        salted = twice.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["_sha", "_salt"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    made = joined.select("page_id", "url", "_payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit")).mapInArrow(_bundles(bundle_bytes, frame_bytes), BUNDLES)
    return materialise(made, "warc")


def index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: page_id, bundle, frame, offset in the frame's content, length."""
    return bundles.select("bundle", F.explode("places").alias("_p")).select("_p.page_id", "bundle", "_p.frame", "_p.offset", "_p.length")


def rebuilt(archives: DataFrame) -> DataFrame:
    """BUNDLES of archives (bundle, archive), such as exported files, whose index is made anew by a scan."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for data in batch.column(1):
            whole = Archive(data.as_buffer()).scan()
            found.append([{"page_id": _key(parse(x)[0]["WARC-Record-ID"]), "frame": k, "offset": at, "length": len(x)} for k, at, x in whole])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _PLACES)], names=["bundle", "archive", "places"])

    return archives.select("bundle", "archive").mapInArrow(per_batch(rows), BUNDLES)


def _checked(data: bytes, key: int | None) -> tuple[dict[str, str], int, bytes]:
    """Headers, payload length and payload of a record that must be of this id. The digest of a response is computed anew and must agree."""
    headers, http, payload = parse(data)
    if _key(headers["WARC-Record-ID"]) != key:
        raise ValueError("the index names another record")
    length = int(http.rpartition(b"Content-Length: ")[2])
    if headers["WARC-Type"] == "response" and (headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}" or length != len(payload)):
        raise ValueError("a payload doesn't match its digest")
    return headers, length, payload


def read(bundles: DataFrame) -> DataFrame:
    """A row for each record, found by the index and read from the archives."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for data, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            archive = Archive(data.as_buffer())
            for p in places:
                headers, length, _ = _checked(archive.record(p["frame"], p["offset"], p["length"]), p["page_id"])
                kind = headers["WARC-Type"]
                out.append((p["page_id"], length, headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, _key(headers["WARC-Refers-To"]) if kind == "revisit" else None))
        return _table(out, _HEAD, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])

    return bundles.select("archive", "places").mapInArrow(per_batch(rows), _HEAD)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, url and payload of the records of wanted's page_ids; of each bundle only their frames are decompressed. A revisit's payload is null."""
    ids = wanted.select(F.col("page_id").cast("long").alias("page_id")).distinct()
    found = index(bundles).join(ids, "page_id").groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "page_id"))).alias("_wanted"))
    ddl = "page_id long, url string, payload binary"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for data, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            archive = Archive(data.as_buffer())
            for p in places:
                headers, _, payload = _checked(archive.record(p["frame"], p["offset"], p["length"]), p["page_id"])
                out.append((p["page_id"], headers["WARC-Target-URI"], payload if headers["WARC-Type"] == "response" else None))
        return _table(out, ddl, [pa.int64(), pa.string(), pa.binary()])

    return bundles.select("bundle", "archive").join(found, "bundle").select("archive", "_wanted").mapInArrow(per_batch(rows), ddl)


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as `<sha256>.warc.zst` in a folder that all executors see as local; paths and sizes."""
    import os

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        os.makedirs(folder, exist_ok=True)
        out = []
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            path = f"{folder}/{name}.warc.zst"
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data.as_buffer())
            os.replace(part, path)  # a retried task writes the same bytes
            out.append((path, len(data.as_buffer())))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["path", "bytes"])

    return bundles.select("bundle", "archive").mapInArrow(per_batch(put), "path string, bytes long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages")))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS hex FROM p),
bits AS (
  SELECT page_id, array_to_string(list_transform(generate_series(1, 40), lambda i: right('000' || bin(('0x' || substr(hex, i, 1))::INTEGER), 4)), '') AS b FROM f
),
b32 AS (
  SELECT page_id, array_to_string(list_transform(generate_series(1, 156, 5),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(b, i, 5))::INTEGER + 1, 1)), '') AS digest FROM bits
)
SELECT f.page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN f.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.page_id <> first THEN first END AS refers_to
FROM f JOIN b32 USING (page_id)
"""
