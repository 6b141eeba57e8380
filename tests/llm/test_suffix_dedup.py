import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rampart.llm import hashing, suffix_dedup
from rampart.llm.suffix_dedup import Suffixes, dedup_strings, merge_sort, merged, op4_suffix_dedup, ranges, repeats

from .helpers import none, odd_docs, prose, table


def plain(texts, length):
    """(bytes, removed, runs, kept) of each."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        runs = merged([(k, k + length) for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1])
        edges = [0, *(x for r in runs for x in r), len(b)]
        kept = b"".join(b[i:j] for i, j in zip(edges[0::2], edges[1::2], strict=True))
        out.append((len(b), len(b) - len(kept), len(runs), kept))
    return out


def got_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, r, k, hashlib.sha256(b).hexdigest()) for (i, _), (n, r, k, b) in zip(rows, plain([t for _, t in rows], 400), strict=True)}
    got = op4_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(r.kept_bytes == r.n_bytes - r.n_removed and ("\ufffd" in r.text or len(r.text.encode()) == r.kept_bytes) for r in got)


def passages():
    share = prose(50, 40)
    rows = [(k, prose(k, 20 + k) + " | " + share[k % 7 : len(share) - k % 5] + " | " + prose(k + 60, 12)) for k in range(30)]
    return rows + [(40, share + share), (41, "ab" * 300), (42, "é" * 90), (43, "x" * 30), (44, rows[3][1]), (45, None)]


def test_short_strings_and_crowded_grams(spark):
    rows = passages()
    want = sorted((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], 40), strict=True))
    assert got_of(dedup_strings(table(spark, rows), length=40)) == want
    assert got_of(dedup_strings(table(spark, rows), length=40, hot=2)) == want


def test_bytes_decide_not_words(spark):
    """Of two passages of over 50 words in two texts each, the one of 399 bytes stays, by contract, and the one of 400 goes."""
    short, full = prose(3, 90)[:399], prose(5, 90)[:400]
    assert min(len(p.split()) for p in (short, full)) > 50
    rows = [(1, f"a{short}b"), (2, f"c{short}d"), (3, f"a{full}b"), (4, f"c{full}d")]
    want = sorted((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], 400), strict=True))
    got = got_of(dedup_strings(table(spark, rows)))
    assert got == want and [r[2] for r in got] == [0, 0, 400, 400]


def test_passages_go_by_the_length_asked_for(spark):
    """A passage of over 50 words and 352 bytes in three texts stays at 400 bytes and goes from all three at 256; a text of its own is left alone."""
    share = prose(7, 90)[:350]
    assert len(share.split()) > 50
    rows = [(k, f"{prose(20 + k, 30)}<{share}>{prose(40 + k, 30)}") for k in range(3)] + [(3, prose(60, 120))]
    for length, removed in ((400, [0, 0, 0, 0]), (256, [352, 352, 352, 0])):
        got = got_of(dedup_strings(table(spark, rows), length=length))
        assert got == sorted((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], length), strict=True))
        assert [r[2] for r in got] == removed


def test_nothing_goes_without_the_sort(spark, monkeypatch):
    def blind(length):
        def run(batches):
            for _ in batches:
                pass
            return iter(())

        return run

    monkeypatch.setattr(suffix_dedup, "_sorted_repeats", blind)
    rows = passages()
    for hot in (20_000, 2):
        got = got_of(dedup_strings(table(spark, rows), length=40, hot=hot))
        # Copies of one text alone go, by SHA-256.
        assert [(i, n) for i, n, removed, *_ in got if removed] == [(i, len(rows[3][1])) for i in (3, 44)] and all(r in (0, n) for _, n, r, *_ in got)


def test_texts_beyond_one_step(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    codes = np.frombuffer(prose(1, 200).encode(), dtype=np.uint8)
    lo, hi, anchor, *_ = ranges(codes, 40)
    assert lo[0] == 0 and hi[-1] == len(codes) - 40 and (lo[1:] == hi[:-1] + 1).all() and ((anchor >= hi) & (anchor <= lo + 40)).all()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=13, max_size=120), st.data())
def test_sort_is_the_suffixes_order(text, data):
    codes = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.arange(len(codes) - 11)
    group = np.array(data.draw(st.lists(st.integers(0, 2), min_size=len(starts), max_size=len(starts))))
    order = merge_sort(Suffixes(codes, starts, 12), group)
    want = sorted(range(len(starts)), key=lambda k: (group[k], text[starts[k] : starts[k] + 12], k))
    assert [(group[k], text[k : k + 12]) for k in order] == [(group[k], text[k : k + 12]) for k in want]


def test_a_lying_hash_is_found_out(monkeypatch):
    monkeypatch.setattr(Suffixes, "common", lambda self, a, b: np.full(len(a), self.length))
    contexts = [b"abcdefgh", b"abcdefgx", b"abcdefgh"]
    first, last = repeats(contexts, np.array([1, 1, 1]), np.array([2, 2, 2]), 8)
    assert first.tolist() == [0, -1, 0] and last.tolist() == [0, -1, 0]


def thue_morse(bits=10):
    word = [bin(i).count("1") & 1 for i in range(1 << bits)]
    return "".join("ab"[b] for b in word), "".join("ba"[b] for b in word)


def test_words_that_share_every_hash_modulo_2_64(spark):
    one, other = (np.frombuffer(w.encode(), dtype=np.uint8) for w in thue_morse(11))
    n = np.array([0]), np.array([len(one)])
    assert hashing.between(hashing.prefix(one), *n) == hashing.between(hashing.prefix(other), *n)
    assert hashing.Residues(one).between(*n) != hashing.Residues(other).between(*n)
    texts = [(1, one.tobytes().decode()), (2, other.tobytes().decode()), (3, "x" + one.tobytes().decode() + "y"), (4, "z" + other.tobytes().decode())]
    want = sorted((i, *x) for (i, _), x in zip(texts, plain([t for _, t in texts], 400), strict=True))
    assert got_of(dedup_strings(table(spark, texts))) == want


def test_residues_are_of_the_bytes_alone():
    codes = np.frombuffer(b"abcab" * 400 + b"abd", dtype=np.uint8)
    held = hashing.Residues(codes)
    assert len(set(held.between(np.arange(0, 2000, 5), np.arange(3, 2003, 5)).tolist())) == 1
    assert held.between(np.array([2000]), np.array([2003])) != held.between(np.array([0]), np.array([3]))


def test_a_forged_context_removes_nothing(spark):
    """A place whose bytes aren't those that the sort has compared ends the job."""
    import pyarrow as pa
    import pytest

    spans = pa.array([[{"a": 0, "b": 4, "proof": hashlib.sha256(b"abcd").digest()}]])
    cut = suffix_dedup._cut([])
    batch = lambda text: pa.RecordBatch.from_arrays([pa.array([text], pa.binary()), spans], names=["_bytes", "spans"])
    assert cut(batch(b"abcdef")).column(3).to_pylist() == [b"ef"]
    with pytest.raises(ValueError, match="126 bits"):
        cut(batch(b"abcxef"))


def test_text_of_cut_characters(spark):
    df = spark.createDataFrame([(b"a\xc3\xa9b\xa9c\xc3",), (b"",), (None,)], "kept binary").select(suffix_dedup.text_of(F.col("kept")).alias("t"))
    assert [r.t for r in df.collect()] == ["a\u00e9b\ufffdc\ufffd", "", None]


def test_many_kinds_meet_in_deals(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_TEXTS", 1)
    rows = passages()
    want = sorted((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], 40), strict=True))
    assert got_of(dedup_strings(table(spark, rows), length=40)) == want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = dedup_strings(docs).collect()
    assert len(got) == 12 and all(r.n_removed == r.n_bytes for r in got if r.doc_id in (1, 7))
    assert [(r.n_bytes, r.n_removed) for r in got if r.doc_id in (2, 3)] == [(0, 0), (0, 0)]
    assert dedup_strings(none(spark)).count() == 0
    kept = dedup_strings(docs, ("doc_id", "row", "t1"))
    assert kept.columns[:3] == ["doc_id", "row", "t1"]
