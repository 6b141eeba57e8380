"""Packing token sequences by best-fit decreasing.

A document's ids are cut into full windows of `window` ids and one rest, so the
pieces follow from the document alone and one pass over the texts yields their
lengths and checksums. Only those few numbers a piece are shuffled, dealt out and
sorted by a hash. Each task packs runs of RUN_PIECES of its pieces, longest first: a
segment tree over remaining capacity finds the open window that the piece fits most
tightly. A task holds one run at a time, whatever the size of the corpus. Windows never
span runs, which costs at most about one part-filled window a run.

Ids come from the tokenizer file. Texts are split into its pre-tokens, whose ids
are kept in a bounded table, as most recur; a text with characters beyond
Latin script, or with one of the tokenizer's special strings, goes to the
tokenizer whole.

Defined cases: a null or empty text has only the closing id; repeated rows are
packed each; pieces are ordered by length, id, start and checksum, so ties and
retried tasks give the same runs and windows; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 2048
#: Pieces that are packed together: some 100 MB of Python objects.
RUN_PIECES = 200_000
CLOSING_ID = 1
#: Pre-tokens whose ids a task keeps: so many of the latest, and as many before those.
CACHE_ENTRIES = 300_000
#: Letters, numbers and white space among the characters of _PLAIN, and how the byte-level
#: pre-tokenizer splits text made of them. On these, all Unicode versions agree.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
PRE_TOKEN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_PLAIN = re.compile("[\x00-ɏ‐-‧€]*")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, sequence_tokens long, padded_to long"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ids:
    """Little-endian 32-bit ids of texts, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, before = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.by_parts = type(self.model).__name__ == "BPE" and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and self.tokenizer.normalizer is None
        self.split, self.characters = re.compile(PRE_TOKEN).findall, _byte_characters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """The ids of a pre-token, from the tokenizer's model."""
        if (held := self.before.get(part)) is None:
            held = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.characters))]).tobytes()
        if len(self.known) >= CACHE_ENTRIES:
            self.before, self.known = self.known, {}
        self.known[part] = held
        return held

    def of(self, text: str) -> bytes:
        if not self.by_parts or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        get, part = self.known.get, self._part
        return b"".join([get(w) or part(w) for w in self.split(text)])


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """The pieces of each document's ids, with the closing id last."""
    closing = int(closing_id).to_bytes(4, "little")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None
        for batch in batches:
            ids = ids or Ids(tokenizer)
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(ids.of(text.as_py() or "") + closing)
                n = len(data) // 4
                rows += [(doc, a, b - a, zlib.crc32(data[4 * a : 4 * b]), n) for a in range(0, n, window) for b in (min(n, a + window),)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree holds how many of each there are."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, room: int, which: int) -> None:
        self.held[room].append(which)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room that is at least `need`, and that room."""
        node = need + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.tree[node]:
                    node += 1
        room = node - self.size
        self._add(room, -1)
        return self.held[room].pop(), room


def best_fit(lengths: Iterable[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """Window and offset of each length (longest first), and how full each window is."""
    tree, at, offsets, full = OpenWindows(window), [], [], []
    for n in lengths:
        if n == window or (found := tree.take(n)) is None:
            which, room = len(full), window
            full.append(0)
        else:
            which, room = found
        at.append(which)
        offsets.append(window - room)
        full[which] += n
        if room > n:
            tree.put(room - n, which)
    return at, offsets, full


def pack(cut: DataFrame, window: int = WINDOW, run_pieces: int = RUN_PIECES) -> DataFrame:
    """pieces() with sequence_id, offset, sequence_tokens and padded_to."""

    def packed(rows: pa.Table, first: int) -> tuple[pa.Table, int]:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offsets, full = best_fit(rows.column("length").to_pylist(), window)
        at, full = np.array(at, dtype=np.int64), np.array(full, dtype=np.int64)
        padded = np.where(full & (full - 1) == 0, full, window)
        out = rows.append_column("sequence_id", pa.array(at + first)).append_column("offset", pa.array(offsets, pa.int64()))
        return out.append_column("sequence_tokens", pa.array(full[at])).append_column("padded_to", pa.array(padded[at])), len(full)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in (b for b in batches if b.num_rows):
            while size + batch.num_rows >= run_pieces:
                held.append(batch.slice(0, run_pieces - size))
                batch = batch.slice(run_pieces - size)
                out, n = packed(pa.Table.from_batches(held), first)
                yield from out.to_batches(max_chunksize=100_000)
                first, held, size = first + n, [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield from packed(pa.Table.from_batches(held), first)[0].to_batches(max_chunksize=100_000)

    # The rests of one id may be many (repeated rows), so the id alone doesn't deal them out.
    dealt = F.xxhash64("doc_id", "start", "ids_crc32")
    return cut.repartition(dealt).sortWithinPartitions(dealt, "doc_id", "start", "ids_crc32").mapInArrow(run, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
