"""Two tokenizers held against each other: where their tokens end together, which ids meet, and how usual that is.

Both tokenizers read a text with a space before it. Neither joins bytes across a space
that follows a character other than white space (checked for the vocabulary of B; a
tokenizer that could is used on whole texts). So texts are cut there, and what is
worked out for one cut piece (its ids, groups and links) holds wherever it recurs;
a task keeps the latest pieces in a bounded table.

Per document, an Arrow pass writes its figures and the multiplicity of each linked pair
of ids to a shared table. Then come the postings:

1. multiplicities are summed by pair (map side first), and the highest sum of each B id
   is found: a row for each id at most, the only thing that is broadcast;
2. postings (pair, document, multiplicity) are shuffled by B id together with the sums,
   and sorted by pair with the sum in front: Spark's sort spills as it must. A B id with
   more than a thousandth of all postings is dealt out by document, with its sums;
3. each task walks its sorted stream with one sum held, and emits what every posting
   adds to its document; these are summed by document.

Defined cases: a null or empty text, or one whose tokens of A or B don't join to its own
bytes (as U+2581 in a text, which B takes for a space), has no tokens, zeros and ''; rows
are told apart by a key of their own, so repeated ids and null ids stay rows; strings of
special tokens are ordinary text; texts of any length are worked on whole; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_chunks
from .packing import _LETTER, _byte_characters, tokenizer_path

#: Pieces that a task keeps: so many of the latest, and as many before those; longer ones aren't kept.
CACHE_ENTRIES = 100_000
CACHED_LENGTH = 60
#: Postings that a task holds before it passes them on.
HELD_POSTINGS = 500_000
#: A B id with more than this share of all postings is dealt out.
HOT_SHARE = 1_000
_JOINS_BACK = re.compile(r"(?:^|\s) ")
ALIGNED = "ref long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, postings array<struct<pair: long, m: int>>"
_POSTING = pa.struct([("pair", pa.int64()), ("m", pa.int32())])
_SIDE = "SHIFTRIGHT(pair, 32)"


def piece_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


#: Figures of a piece of text: n_a, n_b, n_groups, links (B id << 32 | A id), groups as text.
Piece = tuple[int, int, int, tuple[int, ...], str]
#: Stands for a piece whose bytes differ between the sides.
_NOT_ALIKE: Piece = (-1, 0, 0, (), "")
_BEYOND = "\n"
_ATOMS = re.compile(rf"[{_LETTER}]+[!-/:-@[-`{{-~]*(?:\n[{_LETTER}]+[!-/:-@[-`{{-~]*)*")
_WORD = re.compile(rf" ?[{_LETTER}]+")
_ATOM = re.compile(rf"[{_LETTER}]+|\n|[^{_LETTER}\n]+")


class Aligner:
    """Groups and links of texts under tokenizer files A (byte-level) and B (pieces with byte fallback).

    Pieces are cut once more into words, marks and line ends where no entry of B holds the two characters at the cut
    (A always cuts there), so that a word is worked out once, whatever follows it.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        before = self.a.pre_tokenizer
        self.by_parts = type(self.a.model).__name__ == "BPE" and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and self.a.normalizer is None
        self.characters = _byte_characters()
        own = {c: b for b, c in self.characters.items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(own[c] for c in entry) if all(c in own for c in entry) else entry.encode()
        n = self.b.get_piece_size()
        entries = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.n_names = max(n, len(self.bytes_a))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.n_names)]
        self.name_sizes = np.array([len(x) for x in self.names])
        self.together = {p[k : k + 2] for i, p in enumerate(entries) if not self.b.is_byte(i) for k in range(len(p) - 1)}
        self.cuts = not any(x[0] != "▁" and x[1] == "▁" for x in self.together)
        # What B makes of a line end: then texts without a space in front can be read behind one.
        self.line_end = self.b.encode(_BEYOND)
        self.finer = self.cuts and not any(_BEYOND in x for x in self.together) and len(self.line_end) == 2
        self.known: dict[str, Piece | None] = {}
        self.before: dict[str, Piece | None] = {}
        self.bare: dict[str, Piece | None] = {}

    def _made(self, wanted: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[Piece | None]:
        """Figures of texts from their bytes and ids, None where a side's bytes aren't the text's. All are worked out at once: texts end where both sides' tokens do."""
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (a, b))
        n_a, n_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (a, b))
        sums = [np.append(0, np.cumsum(sizes[flat])) for sizes, flat in ((self.sizes_a, flat_a), (self.sizes_b, flat_b))]
        size_a, size_b = (np.diff(x[np.append(0, np.cumsum(n))]) for x, n in zip(sums, (n_a, n_b), strict=True))
        sizes = np.array([len(w) for w in wanted], dtype=np.int64)
        fine = (size_a == sizes) & (size_b == sizes) & (sizes > 0)
        if fine.all():
            whole = b"".join(wanted)
            if b"".join([self.bytes_a[i] for i in flat_a.tolist()]) == whole and b"".join([self.bytes_b[i] for i in flat_b.tolist()]) == whole:
                return self._grouped(flat_a, flat_b, n_a, n_b)
            fine = np.array([b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for w, x, y in zip(wanted, a, b, strict=True)])
        at = np.flatnonzero(fine).tolist()
        out: list[Piece | None] = [None] * len(wanted)
        if at:
            for k, x in zip(at, self._made([wanted[k] for k in at], [a[k] for k in at], [b[k] for k in at]), strict=True):
                out[k] = x
        return out

    def _grouped(self, flat_a: np.ndarray, flat_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[Piece]:
        if not len(n_a):
            return []
        end_a, end_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        # The B tokens that each A token meets.
        first = np.searchsorted(end_b, end_a - self.sizes_a[flat_a], side="right")
        last = np.searchsorted(end_b, end_a, side="left")
        met = last - first + 1
        after = np.cumsum(met)
        links = (flat_b[np.arange(after[-1]) + np.repeat(first - (after - met), met)] << 32 | np.repeat(flat_a, met)).tolist()
        ends_a, ends_b = end_b[last] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        # Ids in the order of groups, each with what follows it: a comma, a bar after the last A id, a semicolon after the last B id.
        codes = np.empty(len(flat_a) + len(flat_b), dtype=np.int64)
        codes[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a, side="left")] = flat_a + self.n_names * ends_a
        codes[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, side="right")] = flat_b + 2 * self.n_names * ends_b
        names = self.names
        text = "".join([names[c] for c in codes.tolist()])
        until_a, until = np.cumsum(n_a), np.cumsum(n_a + n_b)
        n_groups = np.diff(np.append(0, np.cumsum(ends_a)[until_a - 1])).tolist()
        ends = np.cumsum(self.name_sizes[codes])[until - 1].tolist()
        links_end = after[until_a - 1].tolist()
        rows = zip(n_a.tolist(), n_b.tolist(), n_groups, [0, *links_end], links_end, [0, *ends], ends, strict=False)
        return [(x, y, g, tuple(links[i:j]), text[k : m - 1]) for x, y, g, i, j, k, m in rows]

    def _many(self, texts: list[str]) -> list[Piece | None]:
        """Texts, each with a space in front."""
        spaced = [" " + t for t in texts]
        return self._made([t.encode() for t in spaced], self._ids_a(spaced), self.b.encode(texts, num_threads=1) if texts else [])

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        """Words are one pre-token each and go to A's model itself."""
        words = [bool(self.by_parts and _WORD.fullmatch(t)) for t in texts]
        rest = iter([e.ids for e in self.a.encode_batch_fast([t for t, w in zip(texts, words, strict=True) if not w], add_special_tokens=False)])
        part, characters = self.a.model.tokenize, self.characters
        return [[x.id for x in part(t.encode().decode("latin-1").translate(characters))] if w else next(rest) for t, w in zip(texts, words, strict=True)]

    def whole(self, text: str) -> Piece | None:
        """A text without a cut."""
        return self._many([text])[0]

    def pieces(self, text: str) -> list[str]:
        """The text (without the space in front) cut at each space that follows a character other than white space."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if not _JOINS_BACK.search(text):
            return parts
        out, open_end = [], False
        for part in parts:
            if open_end:
                out[-1] += " " + part
            else:
                out.append(part)
            open_end = not part or part[-1].isspace()
        return out

    def _atoms(self, piece: str) -> list[str]:
        if piece.isalpha() or not self.finer or not _ATOMS.fullmatch(piece):
            return [piece]
        if piece[:-1].isalpha():
            return [piece[:-1], piece[-1]] if piece[-2:] not in self.together else [piece]
        atoms = _ATOM.findall(piece)
        if any(x[-1] + y[0] in self.together for x, y in zip(atoms, atoms[1:], strict=False)):
            return [piece]
        return atoms

    def _learn(self, pieces: list[str]) -> list[Piece | None]:
        """Figures of pieces that aren't known."""
        cut = list(map(self._atoms, pieces))
        known, before, bare = self.known, self.before, self.bare
        found: dict[str, Piece | None] = {}
        for first in [atoms[0] for atoms in cut]:
            found[first] = known[first] if first in known else before.get(first, False)
        new = [p for p, x in found.items() if x is False]
        found |= zip(new, self._many(new), strict=True)
        if len(bare) > CACHE_ENTRIES:
            bare.clear()
        more = list({x for atoms in cut if len(atoms) > 1 for x in atoms[1:] if x not in bare})
        if more:
            ids_b = self.b.encode([_BEYOND + t for t in more], num_threads=1)
            alone = [b[:2] == self.line_end for b in ids_b]
            made = self._made([t.encode() for t in more], self._ids_a(more), [b[2:] for b in ids_b])
            bare |= {t: x if fine else None for t, x, fine in zip(more, made, alone, strict=True)}
        out = []
        for atoms in cut:
            whole = found[atoms[0]]
            for x in atoms[1:] if len(atoms) > 1 else ():
                part = bare[x]
                if whole is None or part is None:
                    whole = None
                    break
                whole = whole[0] + part[0], whole[1] + part[1], whole[2] + part[2], whole[3] + part[3], f"{whole[4]};{part[4]}"
            out.append(whole)
        self._keep(found)
        return out

    def _keep(self, found: dict[str, Piece | None]) -> None:
        for p, x in found.items():
            if len(p) <= CACHED_LENGTH:
                if len(self.known) >= CACHE_ENTRIES:
                    self.before, self.known = self.known, {}
                self.known[p] = x

    def of_many(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, and the pairs (B id << 32 | A id) in order with their multiplicities."""
        cut = [self.pieces(t) if t else [] for t in texts]
        own = list(dict.fromkeys(chain.from_iterable(cut)))
        at = dict(zip(own, range(len(own)), strict=True))
        codes = np.fromiter(map(at.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        known, before = self.known, self.before
        held = [known.get(p, False) for p in own]
        rest = [p for p, x in zip(own, held, strict=True) if x is False]
        found = {p: before[p] for p in rest if p in before}
        new = [p for p in rest if p not in found]
        found |= zip(new, self._learn(new), strict=True)
        self._keep(found)
        held = [found[p] if x is False else x for p, x in zip(own, held, strict=True)]
        n_a, n_b, n_groups, links, names = zip(*[_NOT_ALIKE if x is None else x for x in held], strict=True) if held else ((),) * 5
        figures = np.array([n_a, n_b, n_groups], dtype=np.int64).T
        count = np.fromiter(map(len, links), dtype=np.int64, count=len(links))
        pairs = np.fromiter(chain.from_iterable(links), dtype=np.int64, count=count.sum())
        start = np.cumsum(count) - count
        out, k = [], 0
        for text, pieces in zip(texts, cut, strict=True):
            own = codes[k : k + len(pieces)]
            k += len(pieces)
            each = figures[own]
            if len(own) and (each[:, 0] < 0).any():
                one = self.whole(text)
                own_pairs, total, name = (np.array(one[3], dtype=np.int64), one[:3], one[4]) if one is not None else (pairs[:0], (0, 0, 0), "")
            else:
                n = count[own]
                after = np.cumsum(n)
                own_pairs = pairs[np.arange(after[-1] if len(n) else 0) + np.repeat(start[own] - (after - n), n)]
                total, name = each.sum(axis=0).tolist(), ";".join([names[c] for c in own.tolist()])
            digest = hashlib.sha256(name.encode()).hexdigest() if name else ""
            out.append((*total, len(own_pairs), digest, *np.unique(own_pairs, return_counts=True)))
        return out


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """A Python worker's own, so that its tasks share what they know."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: its figures, and its postings sorted by pair. ref is a key of the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pieces hold no cycles, and looking through a table of them for some takes a tenth of the time.
        gc.disable()
        align, ref = _aligner(path_a, path_b), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        pairs: list[np.ndarray] = []
        ms: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(p) for p in pairs], out=offsets[1:])
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs), pa.int64()), pa.array(np.concatenate(ms).astype(np.int32))], fields=list(_POSTING))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.string()], strict=True)]
            out = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["ref", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "postings"])
            rows.clear(), pairs.clear(), ms.clear()
            return out

        for batch in batches:
            held, ids = 0, batch.column(0).to_pylist()
            for first, texts in text_chunks(batch):
                for k, (n_a, n_b, n_groups, n_links, digest, own, counts) in enumerate(align.of_many(texts), first):
                    rows.append((ref, ids[k], n_a, n_b, n_groups, n_links, digest))
                    pairs.append(own)
                    ms.append(counts)
                    ref, held = ref + 1, held + len(own)
                    if held >= HELD_POSTINGS:
                        yield flush()
                        held = 0
            if rows:
                yield flush()
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_sums(postings: DataFrame) -> DataFrame:
    """pair, n (its links in all documents), docs (its postings)."""
    return postings.groupBy("pair").agg(F.sum("m").alias("n"), F.count("*").alias("docs"))


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a stream sorted by pair, sums (ref < 0) in front: what each posting adds to its document."""
    carried = np.int64(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        ref, m = (batch.column(i).to_numpy() for i in (1, 2))
        last = np.maximum.accumulate(np.where(ref < 0, np.arange(len(ref)), -1))
        n = np.where(last < 0, carried, m[last])
        carried = n[-1]
        own = ref >= 0
        ref, m, n = ref[own], m[own], n[own]
        yield pa.RecordBatch.from_arrays([pa.array(ref), pa.array(m * (n > 0)), pa.array(m * np.abs(n))], names=["ref", "n_best", "count_sum"])


def contributions(postings: DataFrame) -> DataFrame:
    """ref, n_best, count_sum of each posting (pair, ref, m)."""
    spark = postings.sparkSession
    sums = materialise(pair_sums(postings), "pairs").withColumn("b", F.expr(_SIDE))
    total = sums.agg(F.sum("docs")).first()[0] or 1
    # A row for each id of B's vocabulary at most.
    sides = sums.groupBy("b").agg(F.max("n").alias("best"), (F.expr(f"SUM(docs) * {HOT_SHARE} DIV {total}") + 1).cast("int").alias("salts"))
    sides = materialise(sides, "sides")
    # A sum is negative unless it is its B id's highest; its ref says which deal it goes to.
    heads = sums.join(F.broadcast(sides), "b").select("pair", F.explode(F.sequence(F.expr("-salts"), F.lit(-1))).alias("ref"), F.when(F.col("n") == F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("m"), "salts")
    heads = heads.select("pair", F.col("ref").cast("long").alias("ref"), "m", F.expr("CAST(-1 - ref AS INT)").alias("deal"))
    rows = postings.withColumn("b", F.expr(_SIDE)).join(F.broadcast(sides.select("b", "salts")), "b")
    rows = rows.select("pair", "ref", F.col("m").cast("long").alias("m"), F.expr("CAST(PMOD(HASH(ref), salts) AS INT)").alias("deal"))
    dealt = heads.unionByName(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.expr(_SIDE), "deal")
    return dealt.sortWithinPartitions("pair", "ref").select("pair", "ref", "m").mapInArrow(_added, "ref long, n_best long, count_sum long")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    held = materialise(aligned(docs, path_a, path_b), "aligned")
    postings = held.select("ref", F.inline("postings"))
    added = contributions(postings).groupBy("ref").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = held.drop("postings").join(added, "ref", "left").fillna(0, ["n_best", "count_sum"])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())
