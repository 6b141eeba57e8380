"""Media columns: ISO base media files, read by their boxes and sample tables only.

`store` writes a payload losslessly as grey frames of 16 x 12 samples of 8 bits
(192 bytes a frame) in the media data of a file with one video track. `inspect`
walks the nested boxes and decodes the sample tables (stts, stsz or stz2, stsc, stco
or co64, stss) and the runs of movie fragments (tfhd, trun, with the defaults of trex)
to codec, duration and the byte ranges of key frames. It never touches the payload.
`payload` reads the samples back by those tables.

Defined cases: a null or empty text is one frame of blanks; a file that isn't
complete or whose tables disagree is a row of nulls whose `error` says what is wrong
(`inspect` raises ValueError); repeated rows give equal values; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
RATE = 25
CHUNK_FRAMES = 64
#: Raw frames all stand alone; marking one in so many keeps ranges at the size a player would seek by.
KEY_EVERY = 12
#: Boxes that hold boxes, of those that are written or walked here.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"])
#: Boxes within boxes beyond this are an error, not a deep recursion.
MAX_DEPTH = 32
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes) -> bytes:
    """A file whose samples are the payload, a positive multiple of FRAME bytes."""
    frames, rest = divmod(len(payload), FRAME)
    if not frames or rest:
        raise ValueError("not a positive multiple of a frame")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIIIHHIIIH", 1, 0, 0, 0, 0, 0, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    chunks, last = divmod(frames, CHUNK_FRAMES)
    runs = [(1, CHUNK_FRAMES)] * bool(chunks) + [(chunks + 1, last)] * bool(last)
    keys = range(1, frames + 1, KEY_EVERY)

    def movie(first: int) -> bytes:
        offsets = range(first, first + len(payload), CHUNK_FRAMES * FRAME)
        wide = first + len(payload) > 0xFFFFFFFF
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", chunk, n, 1) for chunk, n in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
        )
        data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), data, tables),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        whole = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", whole, _box(b"trak", track, media))

    large = len(payload) + 8 > 0xFFFFFFFF
    before = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(movie(0)) + len(before)
    return b"".join([head, movie(first), before, payload])


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of body, end) of each box, parents before children."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError("a box is larger than its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes are nested too deep")
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


@dataclass(frozen=True)
class Track:
    codec: str
    handler: str
    timescale: int
    duration: int
    sizes: list[int]
    offsets: list[int]
    keys: list[int]  # from 0
    seconds_of: list[int] = field(default_factory=list)  # of samples in fragments, in units of the time scale
    number: int = 0

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        """Offset and length in bytes of each key frame."""
        return [(self.offsets[k], self.sizes[k]) for k in self.keys]


def _numbers(data, at: int, per: int, code: str, end: int) -> list[tuple[int, ...]]:
    n = struct.unpack_from(">I", data, at)[0]
    step = struct.calcsize(f">{code * per}")
    if at + 4 + n * step > end:
        raise ValueError("a sample table is cut short")
    return list(struct.iter_unpack(f">{code * per}", data[at + 4 : at + 4 + n * step]))


def _sizes(data, found: dict[bytes, tuple[int, int]]) -> list[int]:
    """Of each sample, by stsz or its compact form stz2."""
    if b"stsz" in found:
        a, end = found[b"stsz"]
        same, n = struct.unpack_from(">II", data, a + 4)
        if same * n > len(data):
            raise ValueError("samples are larger than the file")
        return [same] * n if same else [x for (x,) in _numbers(data, a + 8, 1, "I", end)]
    a, end = found[b"stz2"]
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits in (8, 16):
        return [x for (x,) in _numbers(data, a + 8, 1, "B" if bits == 8 else "H", end)]
    if bits != 4 or a + 12 + (n + 1) // 2 > end:
        raise ValueError("a sample table is cut short")
    return [data[a + 12 + k // 2] >> (0 if k & 1 else 4) & 15 for k in range(n)]


#: Flags of tfhd and trun, and the bit of a sample's flags that says it isn't a key frame.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, SAMPLE_FLAGS, MOOF_BASE = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
DATA_OFFSET, FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_TIME = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_KEY = 0x10000


def _fields(data, at: int, end: int, flags: int, *wanted: tuple[int, str]) -> tuple[list[int | None], int]:
    """Values of the fields whose flags are set, in order, and where they end."""
    out: list[int | None] = []
    for flag, code in wanted:
        if flags & flag:
            if at + struct.calcsize(">" + code) > end:
                raise ValueError("a fragment is cut short")
            out.append(struct.unpack_from(">" + code, data, at)[0])
            at += struct.calcsize(">" + code)
        else:
            out.append(None)
    return out, at


def _fragment(data, track: Track, traf: list[tuple[bytes, int, int]], defaults: tuple[int, int, int], moof: int, end_of_last: int | None) -> int:
    """Adds the samples of a track fragment, and gives where its data end. defaults: duration, size and flags of trex."""
    _, a, end = next(x for x in traf if x[0] == b"tfhd")
    flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
    (base, _, duration, size, own), _ = _fields(data, a + 8, end, flags, (BASE_OFFSET, "Q"), (DESCRIPTION, "I"), (DURATION, "I"), (SIZE, "I"), (SAMPLE_FLAGS, "I"))
    duration, size, own = (d if x is None else x for x, d in zip((duration, size, own), defaults, strict=True))
    base = base if base is not None else moof if flags & MOOF_BASE or end_of_last is None else end_of_last
    at = base
    for _, a, end in (x for x in traf if x[0] == b"trun"):
        flags, n = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        (offset, first), a = _fields(data, a + 8, end, flags, (DATA_OFFSET, "i"), (FIRST_FLAGS, "I"))
        at = base + offset if offset is not None else at
        if n > len(data):
            raise ValueError("more samples than bytes")
        for k in range(n):
            (d, s, f, _), a = _fields(data, a, end, flags, (RUN_DURATION, "I"), (RUN_SIZE, "I"), (RUN_FLAGS, "I"), (RUN_TIME, "I"))
            s, f = size if s is None else s, first if k == 0 and first is not None else own if f is None else f
            track.sizes.append(s)
            track.offsets.append(at)
            track.seconds_of.append(duration if d is None else d)
            if not f & NOT_KEY:
                track.keys.append(len(track.sizes) - 1)
            at += s
    return at


def _track(data, found: dict[bytes, tuple[int, int]]) -> Track:
    def at(kind: bytes) -> tuple[int, int]:
        if kind not in found:
            raise ValueError(f"no {kind.decode('latin-1')} box")
        return found[kind]

    a, _ = at(b"mdhd")
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[at(b"stsd")[0] + 12 : at(b"stsd")[0] + 16]).decode("latin-1")
    handler = bytes(data[at(b"hdlr")[0] + 8 : at(b"hdlr")[0] + 12]).decode("latin-1")
    if b"stz2" not in found:
        at(b"stsz")
    sizes = _sizes(data, found)
    n = len(sizes)
    wide = b"co64" in found
    a, end = at(b"co64" if wide else b"stco")
    chunks = [x for (x,) in _numbers(data, a + 4, 1, "Q" if wide else "I", end)]
    a, end = at(b"stsc")
    runs = _numbers(data, a + 4, 3, "I", end)
    offsets: list[int] = []
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)
        for chunk in chunks[first - 1 : last]:
            for _ in range(min(per, n - len(offsets))):
                offsets.append(chunk)
                chunk += sizes[len(offsets) - 1]
    a, end = at(b"stts")
    timed = sum(count for count, _ in _numbers(data, a + 4, 2, "I", end))
    if len(offsets) != n or timed != n:
        raise ValueError("the sample tables disagree")
    keys = [k - 1 for (k,) in _numbers(data, found[b"stss"][0] + 4, 1, "I", found[b"stss"][1])] if b"stss" in found else list(range(n))
    if keys and max(keys) >= n:
        raise ValueError("a key frame is beyond the last sample")
    a, end = found.get(b"tkhd", (0, 0))
    number = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0] if end else 0
    return Track(codec, handler, timescale, duration, sizes, offsets, keys, number=number)


def inspect(data: bytes | memoryview) -> list[Track]:
    """The tracks of a file, with the samples of its fragments. Raises ValueError for a file that isn't sound."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []
    moof = 0
    try:
        for path, start, end in boxes(data):
            kind = path[-1]
            if kind == b"trak":
                tracks.append({})
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", data, start + 4)
                defaults[number] = tuple(rest)
            elif kind == b"moof":
                moof = start - 8
            elif kind == b"traf":
                fragments.append((moof, []))
            elif b"traf" in path:
                fragments[-1][1].append((kind, start, end))
            elif b"trak" in path:
                tracks[-1].setdefault(kind, (start, end))
        out = [_track(data, found) for found in tracks]
        last: tuple[int, int | None] = (0, None)
        for moof, traf in fragments:
            header = next((a for kind, a, _ in traf if kind == b"tfhd"), None)
            number = struct.unpack_from(">I", data, header + 4)[0] if header is not None else None
            track = next((t for t in out if t.number == number), None)
            if track is None:
                raise ValueError("a fragment of no track")
            ended = _fragment(data, track, traf, defaults.get(number, (0, 0, 0)), moof, last[1] if last[0] == moof else None)
            last = (moof, ended)
        return [replace(t, duration=t.duration + sum(t.seconds_of)) if t.seconds_of else t for t in out]
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"a box is cut short: {e}") from None


def payload(data: bytes | memoryview, track: Track) -> bytes:
    view = memoryview(data)
    if any(a + n > len(view) for a, n in zip(track.offsets, track.sizes, strict=True)):
        raise ValueError("a sample is beyond the end of the file")
    return b"".join(view[a : a + n] for a, n in zip(track.offsets, track.sizes, strict=True))


MEDIA = "doc_id long, n_bytes long, media binary"
FOUND = "codec string, handler string, timescale long, duration long, frames long, key_ranges array<struct<offset:long,length:long>>, error string"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % FRAME or FRAME * (not raw))


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the file that stores each text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [padded(x.as_py()) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([store(x) for _, x in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch(rows), MEDIA)


def media_columns(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The key and what the first track of each file says; nulls where there is no file, no track or an `error`."""
    kind = files.schema[key].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for x in batch.column(1):
            try:
                tracks = inspect(memoryview(x.as_buffer())) if x.is_valid else []
            except ValueError as e:
                out.append((None,) * 6 + (str(e),))
                continue
            out.append((t.codec, t.handler, t.timescale, t.duration, len(t.sizes), [{"offset": a, "length": n} for a, n in t.key_ranges()], None) if tracks and (t := tracks[0]) else (None,) * 7)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[key, "codec", "handler", "timescale", "duration", "frames", "key_ranges", "error"])

    return files.select(key, media).mapInArrow(per_batch(rows), f"`{key}` {kind}, {FOUND}")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(files: DataFrame) -> DataFrame:
    """What the stored files hold, read back through their sample tables."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for x in batch.column(2):
            data = memoryview(x.as_buffer())
            track = inspect(data)[0]
            back, keys = payload(data, track), track.key_ranges()
            ranges = zlib.crc32(b"".join(struct.pack(">QQ", *k) for k in keys))
            feature = f"codec={track.codec.strip()} duration={track.duration}/{track.timescale} frames={len(track.sizes)} keyframes={len(keys)} first={keys[0][0]}+{keys[0][1]} last={keys[-1][0]}+{keys[-1][1]} ranges={ranges:08x}"
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[f.split()[0] for f in DIGEST.split(", ")])

    return files.mapInArrow(per_batch(rows), DIGEST)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_media(table(spark, sf_dir, "documents")))
