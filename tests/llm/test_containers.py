"""WARC bundles and media files."""

import contextlib
import hashlib
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rampart.llm import warc
from rampart.llm.media import FRAME, boxes, inspect, media_columns, op10_media_columns, padded, payload, store, with_media
from rampart.llm.warc import Archive, Bundle, digest, fetch, index, op9_warc, parse, read, rebuilt, record, seek_table, write

from .helpers import none, odd_docs


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, bundle string").withColumn("_sha", F.lit("mine"))


def test_pages_round_trip(spark, sf):
    held = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for r in sorted(held, key=lambda r: r.page_id):
        first.setdefault(r.html, r.page_id)
    got = {r.page_id: r for r in op9_warc(spark, sf).collect()}
    assert len(got) == len(held)
    for p in held:
        r, data = got[p.page_id], (p.html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))


def test_any_record_is_read_alone(spark):
    rows = [(k, f"https://h/{k}", f"<p>{k % 4}" * (k + 1), "mine") for k in range(30)]
    bundles = write(pages(spark, rows), bundle_bytes=900, frame_bytes=1500)
    data = {b.bundle: bytes(b.archive) for b in bundles.collect()}
    places = index(bundles).collect()
    assert len(data) > 1 and len({(p.bundle, p.frame) for p in places}) < 30 and {p.offset for p in places} != {0}
    for at in places:
        headers, _, body = parse(Archive(data[at.bundle]).record(at.frame, at.offset, at.length))
        assert headers["WARC-Record-ID"] == f"<urn:page:{at.page_id}>" and (headers["WARC-Type"] == "revisit" or body.decode() == rows[at.page_id][2])
    assert sorted(index(rebuilt(bundles)).collect()) == sorted(places)
    got = {r.page_id: r for r in fetch(bundles, spark.createDataFrame([(3,), (29,), (29,), (77,)], "page_id long")).collect()}
    assert set(got) == {3, 29} and all(bytes(r.payload).decode() == rows[i][2] and r.url == rows[i][1] for i, r in got.items())


def test_a_wrong_place_is_found_out(spark):
    bundles = write(pages(spark, [(1, "u", "a", None), (2, "u", "b", None)]), frame_bytes=10_000)
    off = F.transform("places", lambda p: p.withField("page_id", 3 - p["page_id"]))
    with pytest.raises(Exception, match="another record"):
        read(bundles.withColumn("places", off)).collect()


def test_bundle_is_plain_zstandard_too():
    b = Bundle(frame_bytes=120)
    parts = [bytes([k]) * (k * 50) for k in range(1, 7)]
    for k, p in enumerate(parts):
        b.add(k, p)
    data = b.close()
    assert [c for _, _, c in seek_table(data)] == [150, 150, 200, 250, 300] and [p[1:3] for p in b.places] == [(0, 0), (0, 50), (1, 0), (2, 0), (3, 0), (4, 0)]
    out, at = b"", 0
    for start, size, _ in seek_table(data):
        out += zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=1 << 20)
        at = start + size
    assert out == b"".join(parts) and int.from_bytes(data[at : at + 4], "little") == warc.SKIPPABLE
    with pytest.raises(ValueError):
        seek_table(data[:-1] + b"\0")


def test_records(spark):
    whole = record(5, "https://a b\n", b"x\r\n\r\ny", digest(b"x\r\n\r\ny"), None, False)
    headers, http, body = parse(whole)
    assert body == b"x\r\n\r\ny" and headers["WARC-Target-URI"] == "https://ab" and b"Content-Length: 6" in http
    with pytest.raises(ValueError):
        parse(whole[:-1])


def test_odd_pages(spark):
    rows = [(5, None, "a", None), (3, "u", "a", "mine"), (3, "u", "a", "mine"), (None, "u", "a", None), (None, None, "z", None), (None, None, "z", None), (8, "u", None, None), (9, "u", "", None), (10, "u", "b" * 3_000_000, None)]
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in read(write(pages(spark, rows))).collect()), key=str)
    want = [(5, "revisit", 3, 1), (3, "response", None, 1), (3, "response", None, 1), (-1, "revisit", 3, 1), (-1, "response", None, 1), (-1, "response", None, 1), (8, "response", None, 0), (9, "revisit", 8, 0), (10, "response", None, 3_000_000)]
    assert got == sorted(want, key=str)
    assert {r.record_type for r in read(write(pages(spark, rows), min_revisit_bytes=2)).collect()} == {"response"}
    assert read(write(pages(spark, rows).where("false"))).count() == 0
    salted = read(write(pages(spark, rows), broadcast_digests=0)).collect()
    assert sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in salted), key=str) == got


def test_export(spark, tmp_path):
    bundles = write(pages(spark, [(1, "u", "a", None)]))
    path = warc.export(bundles, str(tmp_path)).first().path
    assert seek_table(open(path, "rb").read())


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=2000))
def test_media_round_trip(text):
    n, data = padded(text.encode("utf-8", "replace").decode())
    file = store(data)
    (track,) = inspect(file)
    assert len(data) % FRAME == 0 and len(data) >= max(n, FRAME) and payload(file, track) == data
    assert track.codec == "raw " and track.duration == len(data) // FRAME and all(a + k <= len(file) for a, k in track.key_ranges())


def test_media_of_many_chunks():
    data = bytes(range(256)) * 3 * 200
    (track,) = inspect(store(data))
    assert payload(store(data), track) == data and len(track.keys) == -(-len(data) // FRAME // 12)
    kinds = [p[-1] for p, _, _ in boxes(store(data))]
    assert kinds[:2] == [b"ftyp", b"moov"] and kinds[-1] == b"mdat"


def test_broken_media():
    file = store(b" " * FRAME)
    for bad in (file[:-1], file[:300], b"\0\0\0\x04free"):
        with pytest.raises(ValueError):
            t = inspect(bad)
            payload(bad, t[0])
    with pytest.raises(ValueError):
        store(b"abc")


def by_hand(kind, *parts):
    """A box as the standard writes it: size, type, content."""
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def u(*values, n=4):
    return b"".join(v.to_bytes(n, "big") for v in values)


def movie(tables, version=0, timescale=90_000, duration=9_000, number=1, more=b""):
    times = u(0, 0, n=8) + u(timescale) + u(duration, n=8) if version else u(0, 0, timescale, duration)
    dates = u(0, 0, n=8) if version else u(0, 0)
    mdhd = by_hand(b"mdhd", u(version << 24), times, u(0x55C4, 0, n=2))
    hdlr = by_hand(b"hdlr", u(0, 0), b"vide", bytes(12), b"\0")
    stsd = by_hand(b"stsd", u(0, 1), by_hand(b"avc1", bytes(78)))
    tkhd = by_hand(b"tkhd", u(version << 24), dates, u(number, 0), u(duration, n=8 if version else 4), bytes(60))
    return by_hand(b"moov", by_hand(b"trak", tkhd, by_hand(b"mdia", mdhd, hdlr, by_hand(b"minf", by_hand(b"stbl", stsd, *tables)))), more)


def test_tables_written_by_hand():
    """Several runs of stsc, stts and ctts, samples of many sizes, 64-bit offsets, headers of version 1."""
    sizes, data = [3, 5, 2, 7, 1], b"aaabbbbbccdddddddeXX"
    stts, ctts = by_hand(b"stts", u(0, 2, 3, 1000, 2, 3000)), by_hand(b"ctts", u(0, 1, 5, 0))
    stsz, stss = by_hand(b"stsz", u(0, 0, 5, *sizes)), by_hand(b"stss", u(0, 2, 1, 4))
    # Chunks 1 and 2 hold two samples each, chunk 3 one. In the file chunk 3 comes before chunk 2.
    stsc = by_hand(b"stsc", u(0, 2, 1, 2, 1, 3, 1, 1))

    def file(first):
        return movie([stts, ctts, stsz, stsc, by_hand(b"co64", u(0, 3), u(first, first + 9, first + 8, n=8)), stss], version=1)

    start = len(file(0)) + 8
    whole = file(start) + by_hand(b"mdat", data)
    (t,) = inspect(whole)
    assert (t.codec, t.handler, t.timescale, t.duration, t.number) == ("avc1", "vide", 90_000, 9_000, 1) and t.sizes == sizes
    assert [o - start for o in t.offsets] == [0, 3, 9, 11, 8] and t.key_ranges() == [(start, 3), (start + 11, 7)]
    assert payload(whole, t) == data[0:3] + data[3:8] + data[9:11] + data[11:18] + data[8:9]
    compact = [(4, bytes([0x35, 0x27, 0x10])), (8, bytes(sizes)), (16, u(*sizes, n=2))]
    for bits, body in compact:
        small = movie([stts, by_hand(b"stz2", u(0), bytes([0, 0, 0, bits]), u(5), body), stsc, by_hand(b"stco", u(0, 3, 10, 20, 30))])
        assert inspect(small)[0].sizes == sizes and inspect(small)[0].keys == [0, 1, 2, 3, 4]


def fragmented():
    empty = [by_hand(b"stts", u(0, 0)), by_hand(b"stsc", u(0, 0)), by_hand(b"stsz", u(0, 0, 0)), by_hand(b"stco", u(0, 0))]
    head = movie(empty, duration=0, number=7, more=by_hand(b"mvex", by_hand(b"trex", u(0, 7, 1, 500, 4, 0x10000))))
    # One run with the first sample's flags and sizes of its own; then one that takes all from trex and goes on where the first ended.
    one = by_hand(b"traf", by_hand(b"tfhd", u(0x20000, 7)), by_hand(b"trun", u(0x000205, 3, 0, 0, 2, 6, 1)), by_hand(b"trun", u(0, 2)))
    size = 8 + len(one)
    one = one.replace(u(0x000205, 3, 0), u(0x000205, 3, size + 8))
    # And one with times and flags for each sample, at an offset from the start of the file.
    before = len(head) + size + 8 + 17
    def two(base):
        return by_hand(b"moof", by_hand(b"traf", by_hand(b"tfhd", u(0x1, 7), u(base, n=8)), by_hand(b"trun", u(0x700, 2, 900, 3, 0x10000, 100, 2, 0))))
    base = before + len(two(0)) + 8
    return head + by_hand(b"moof", one) + by_hand(b"mdat", b"11222222344445555") + two(base) + by_hand(b"mdat", b"66677"), len(head) + size + 8, base


def test_fragments_written_by_hand():
    file, first, base = fragmented()
    (t,) = inspect(file)
    assert t.sizes == [2, 6, 1, 4, 4, 3, 2] and payload(file, t) == b"1122222234444555566677"
    assert t.keys == [0, 6] and t.key_ranges() == [(first, 2), (base + 3, 2)] and t.duration == 5 * 500 + 900 + 100


def test_a_bad_file_is_a_row(spark):
    good, (frag, *_) = store(b" " * FRAME), fragmented()
    deep = b""
    for _ in range(3000):
        deep = by_hand(b"moov", deep)
    bad = [good[:200], b"abc", good.replace(b"stsz", b"xxxx"), deep, frag[:-30].replace(b"tfhd", b"none"), movie([by_hand(b"stsz", u(0, 9, 0xFFFFFFFF))])]
    rows = [(k, x) for k, x in enumerate([good, *bad, frag, None, b""])]
    got = {r.doc_id: r for r in media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[0].error is None and got[0].frames == 1 and got[7].frames == 7 and got[7].error is None
    assert all(got[k].error and got[k].codec is None for k in range(1, 7)) and "deep" in got[4].error
    assert got[8].error is None and got[8].codec is None and got[9].codec is None
    for k in range(0, len(frag), 7):
        with contextlib.suppress(ValueError):
            inspect(frag[:k])


def test_media_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_media_columns(spark, sf).collect():
        n, data = padded(texts[r.doc_id])
        file = store(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and "codec=raw" in r.feature


def test_media_columns(spark):
    files = with_media(odd_docs(spark)).withColumn("media", F.when(F.col("doc_id") != 8, F.col("media")))
    got = {r.doc_id: r for r in media_columns(files).collect()}
    assert got[8].codec is None and got[2].frames == 1 and got[2].key_ranges[0].length == FRAME and got[1].timescale == 25
    assert media_columns(with_media(none(spark))).count() == 0
