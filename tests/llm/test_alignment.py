import hashlib
import random
from collections import Counter, defaultdict

import pytest

from rampart.llm import alignment as A
from rampart.llm.alignment import Aligner, alignment, op11_alignment, piece_path
from rampart.llm.packing import _byte_characters, tokenizer_path

from .helpers import none, odd_docs, table

NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=piece_path())


def plain(tokenizers, rows):
    """Whole texts, every token against every token."""
    a, b = tokenizers
    own = {c: v for v, c in _byte_characters().items()}
    found, count = [], Counter()
    for doc, text in rows:
        if not text:
            found.append((doc, None))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        tokens_a = [bytes(own[c] for c in a.id_to_token(i)) for i in ids_a]
        tokens_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(tokens_a) == b"".join(tokens_b) == (" " + text).encode():
            found.append((doc, None))
            continue
        spans = []
        for tokens in (tokens_a, tokens_b):
            at, spans_of = 0, []
            for t in tokens:
                spans_of.append((at, at + len(t)))
                at += len(t)
            spans.append(spans_of)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, done = [], [0, 0]
        for end in cuts:
            inside = []
            for side, ids in enumerate((ids_a, ids_b)):
                first = done[side]
                while done[side] < len(ids) and spans[side][done[side]][1] <= end:
                    done[side] += 1
                inside.append(",".join(map(str, ids[first : done[side]])))
            groups.append("|".join(inside))
        links = []
        near = 0
        for i, (s, e) in zip(ids_a, spans[0], strict=True):
            while spans[1][near][1] <= s:
                near += 1
            k = near
            while k < len(ids_b) and spans[1][k][0] < e:
                links.append((i, ids_b[k]))
                k += 1
        count.update(links)
        found.append((doc, (len(ids_a), len(ids_b), groups, links)))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc, x in found:
        if x is None:
            out.append((doc, *NONE))
            continue
        n_a, n_b, groups, links = x
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "  a  b ", "a\n b", "a\n\n  b\t c", "x  y", "\x1c z", "a▁b", "ﬁne é́ café", "<|endoftext|> <s> </s> <0x41> <unk>",
    "汉字漢 한국어 日本語", "\U0001f600 \U0001f469‍\U0001f469‍\U0001f467", "it's we'll DON'T 12345 3.14", "x" * 5000, "\x00 a \x00", "﻿bom", "a\r\nb   c", "　wide 　 space",
]


def test_texts_cut_at_spaces_are_as_whole_ones(tokenizers):
    align = Aligner(tokenizer_path(), piece_path())
    assert align.cuts
    random.seed(5)
    made = ["".join(random.choice(["a", "the", "Z", " ", " ", "  ", "\n", "\t", "é", "漢", "'s", "9", ".", " ", "\x1f", " ", "-"]) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    made += [f"{w}{m}" for w in ("Word", "été", "s", "é̂") for m in (",", ".\nNext", "%%%", "'s", "...\nA.\nB!?", "\n", "\n\nx", "/a", "_b", "ʼ")]
    for text, got in zip([*TEXTS, *made], align.of_many([*TEXTS, *made]), strict=True):
        one = align.whole(text) if text else None
        want = (0, 0, 0, 0, "", {}) if one is None else (one[0], one[1], one[2], len(one[3]), hashlib.sha256(one[4].encode()).hexdigest(), Counter(one[3]))
        assert (*got[:5], dict(zip(*(x.tolist() for x in got[5:]), strict=True))) == want, repr(text)


def test_against_every_token(spark, tokenizers, sf):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "the the the of the"), (101, "the the the of the"), (101, "the the the of the"), (None, "of the")]
    got = alignment(table(spark, rows), tokenizer_path(), piece_path())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(tokenizers, rows)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_alignment(spark, sf).collect()), key=str) == plain(tokenizers, docs)


def test_hot_ids_are_dealt_out(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(A, "HOT_SHARE", 100_000)
    rows = [(i, f"the the of w{i % 9} " * (1 + i % 3)) for i in range(120)]
    assert sorted(map(tuple, alignment(table(spark, rows), tokenizer_path(), piece_path()).collect()), key=str) == plain(tokenizers, rows)


def test_a_bounded_table_forgets(tokenizers, monkeypatch):
    monkeypatch.setattr(A, "CACHE_ENTRIES", 3)
    align = Aligner(tokenizer_path(), piece_path())
    text = " ".join(f"w{i % 11}" for i in range(200))
    one = align.whole(text)
    assert align.of_many([text, "w0", text])[2][:4] == (one[0], one[1], one[2], len(one[3])) and len(align.known) <= 3 and align.of_many(["w1 w2"])[0][:5] == align.of_many(["w1 w2"])[0][:5]


def test_odd_rows(spark, tokenizers):
    docs = odd_docs(spark)
    got = alignment(docs, tokenizer_path(), piece_path())
    assert sorted(map(tuple, got.collect()), key=str) == plain(tokenizers, [(r.doc_id, r.text) for r in docs.collect()])
    assert alignment(none(spark), tokenizer_path(), piece_path()).collect() == []
