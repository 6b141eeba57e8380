import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rampart.llm.packing import Ids, best_fit, op3_packing, pack, pieces, tokenizer_path

from .helpers import none, odd_docs


def plain_best_fit(lengths, window):
    room, at, offsets = [], [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if n == window or not fits:
            room.append(window)
            k = len(room) - 1
        else:
            best = min(fits)
            k = max(i for i, r in enumerate(room) if r == best)
        at.append(k)
        offsets.append(window - room[k])
        room[k] -= n
    return at, [window - r for r in room], offsets


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    at, offsets, full = best_fit(lengths, 64)
    _, plain_full, _ = plain_best_fit(lengths, 64)
    assert sorted(full) == sorted(plain_full) and sum(full) == sum(lengths) and all(f <= 64 for f in full)
    ends = {}
    for k, o, n in zip(at, offsets, lengths, strict=True):
        assert o == ends.get(k, 0)
        ends[k] = o + n


def test_ids_are_the_tokenizers(spark, sf):
    ids = Ids(tokenizer_path())
    random.seed(3)
    texts = ["".join(random.choice("ab Z9²½é\n\t\x1c\x85\xa0'sre.…—€ª\x00  ") for _ in range(random.randint(0, 60))) for _ in range(800)]
    texts += ["", "<|endoftext|> a", "汉字 x", "it's we'll  \n\n x", *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect())]
    for t in texts:
        assert ids.of(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def check(rows, texts):
    ids = Ids(tokenizer_path())
    whole = {i: ids.of(t or "") + (1).to_bytes(4, "little") for i, t in texts.items()}
    for i, data in whole.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        at = 0
        for start, length, crc, n in own:
            assert start == at and n == len(data) // 4 and zlib.crc32(data[4 * start : 4 * (start + length)]) == crc
            at += length
        assert at == len(data) // 4


def gapless(rows):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 for n in ends.values())
    return ends


def test_pieces_and_padding(spark, sf):
    rows = op3_packing(spark, sf).collect()
    check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    full = gapless(rows)
    padded = {r.sequence_id: r.padded_to for r in rows}
    assert all(padded[k] == (n if n & (n - 1) == 0 else 2048) for k, n in full.items())
    assert sum(full.values()) > 0.9 * sum(padded.values())


def test_runs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = pieces(docs, tokenizer_path()).coalesce(1)
    whole, runs = pack(cut).collect(), pack(cut, run_pieces=7).collect()
    check(runs, texts)
    assert len(gapless(runs)) > len(gapless(whole)) and len({r.sequence_id for r in runs}) == len(gapless(runs))
    assert pack(cut, run_pieces=7).collect() == runs


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = pack(pieces(docs, tokenizer_path())).collect()
    gapless(rows)
    assert [r.doc_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert len([r for r in rows if r.doc_id == 7 and r.start == 0]) == 2 and any(r.doc_id is None for r in rows)
    assert pack(pieces(none(spark), tokenizer_path())).count() == 0
