"""Removal of long repeated strings by a hash-compared suffix sort.

A byte goes if it lies in a string of `length` bytes that starts at another place
too, of the same text or any other. Sorting every suffix of the corpus would move
each many times, so the suffixes are narrowed first, without loss:

1. Each start i of such a string (a window) belongs to its anchor, the place of the
   least hash among the grams of GRAM bytes inside the window. Equal windows have
   equal grams at equal distance, so windows can only match under one gram. The
   starts with one anchor are a range of at most `length - GRAM + 1`.
2. Counts of context hashes, which combine on the map side, narrow the ranges: those whose
   gram occurs once hold no repeat and go no further. Of a context that occurs often, two
   places stand for all.
3. The contexts that are left come together by gram. There the suffixes are merge-sorted.
   Two are compared by binary search for their common extension over prefix polynomial
   hashes, so a comparison takes a logarithmic number of steps. Neighbours that share
   `length` bytes are repeats, once their bytes have been compared; where a hash lied, the
   bytes decide. Nothing is removed on counts alone: a context that occurs often goes from
   all its places if the sort found its two places equal, and the bytes of every one of
   these places have the SHA-256 of the two.

A gram with more than HOT_CONTEXTS contexts isn't gathered. Its frequent contexts are
sorted under the context's own hash, and the windows of the others under the window's,
so each group has two contexts, and the sort and the bytes decide there too.

Of one text that occurs in several rows all goes, once SHA-256 agrees that it is one text.
Texts are told apart by 128 bits, contexts by 126 and grams by 64; should two texts or
contexts share them, the job ends with an error and removes nothing.

Defined cases: a null text is empty; texts shorter than `length` are kept whole;
repeated rows are copies, so each goes whole if long enough; a null id passes
through; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, per_batch, table
from .hashing import U64, Residues, between, mix, powers, prefix

LENGTH = 400
GRAM_SHARE = 2  # a gram is a half of the length
STEP = 1 << 20  # windows of a long text that are held at once
_PLACE = U64(26)
HOT_CONTEXTS = 20_000
SORT_BYTES = 1_000_000
BROADCAST_TEXTS = 1_000_000
SALTS = 32


def _gram(length: int) -> int:
    return max(1, length // GRAM_SHARE)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    n = len(x)
    whole = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    whole[:n] = x
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def ranges(codes: np.ndarray, length: int) -> list[np.ndarray]:
    """First and last start, anchor, gram hash and two context hashes of each range of a text's bytes."""
    gram, found = _gram(length), []
    width = length - gram + 1
    for at in range(0, len(codes) - length + 1, STEP):
        part = codes[at : at + STEP + length - 1]
        sums = prefix(part)
        grams = mix((sums[gram:] - sums[:-gram]) * powers(len(sums), inverse=True)[: len(sums) - gram])
        keyed = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = _sliding_min(keyed, width) & ((U64(1) << _PLACE) - U64(1))
        turn = np.flatnonzero(place[1:] != place[:-1]) + 1
        lo = np.append(0, turn)
        hi = np.append(turn - 1, len(place) - 1)
        anchor = place[lo].astype(np.int64)
        shape = mix(((anchor - lo) * (length + 1) + (hi - lo)).astype(np.uint64))
        contexts = [mix(h ^ shape) for h in (between(sums, lo, hi + length), Residues(part).between(lo, hi + length))]
        found.append([lo + at, hi + at, anchor + at, grams[anchor], *contexts])
    return [np.concatenate(c) for c in zip(*found, strict=True)]


RANGES = "t1 long, t2 long, lo long, hi long, anchor long, gram long, c1 long, c2 long"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _anchored(length: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, parts, counts = [], [], []
        for t1, t2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            codes = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            if len(codes) >= length:
                parts.append(ranges(codes, length))
                keys.append((t1, t2))
                counts.append(len(parts[-1][0]))
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 8, names=_names(RANGES))
        ids = np.repeat(np.array(keys, dtype=np.int64), counts, axis=0)
        columns = [np.concatenate(c).view(np.int64) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[:, 0], ids[:, 1], *columns)], names=_names(RANGES))

    return rows


class Suffixes:
    """Suffixes of some bytes, compared up to `length` by hashes of their prefixes."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, length: int):
        self.codes, self.starts, self.length = codes, starts, length
        self.sums, self.scale = prefix(codes), powers(len(codes) + 1, inverse=True)[starts]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that each pair of suffixes has in common, by binary search."""
        x, y = self.starts[a], self.starts[b]
        sx, sy, kx, ky = self.sums[x], self.sums[y], self.scale[a], self.scale[b]
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.length, dtype=np.int64)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[x + mid] - sx) * kx == (self.sums[y + mid] - sy) * ky
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix a comes before b, and whether they are equal up to `length`."""
        n = self.common(a, b)
        equal = n >= self.length
        at = np.minimum(n, self.length - 1)
        return ~equal & (self.codes[self.starts[a] + at] < self.codes[self.starts[b] + at]), equal

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, each = np.empty(len(a), dtype=bool), np.arange(self.length)
        for k in range(0, len(a), 2048):
            x, y = self.starts[a[k : k + 2048], None] + each, self.starts[b[k : k + 2048], None] + each
            out[k : k + 2048] = (self.codes[x] == self.codes[y]).all(axis=1)
        return out


def merge_sort(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes: by group, and within each by merge sort. All merges of a width are made at once.

    An element's place in the merged run is its place in its own run and its rank in the other, found by binary search.
    """
    order = np.argsort(group, kind="stable")
    held = group[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    size = np.diff(np.append(first, len(held)))
    base, n = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while width < (size.max() if len(size) else 0):
        at = np.flatnonzero(n > width)  # others are in order already
        b, own = base[at], at - base[at]
        run = own // width
        other = (run ^ 1) * width
        length = np.clip(n[at] - other, 0, width)
        low, high = np.zeros(len(at), dtype=np.int64), length.copy()
        left = run & 1 == 0
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            x, y = order[at[open_]], order[b[open_] + other[open_] + mid]
            before, equal = suffixes.less(y, x)
            before |= equal & ~left[open_]  # of equals, the left run's come first
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        moved = order[at]
        order[b + (run & ~1) * width + own - run * width + low] = moved
        width *= 2
    return order


def repeats(contexts: list[bytes], grams: np.ndarray, distance: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated start within each context, or -1. distance: from a context's first start to its anchor."""
    codes = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    starts_of = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    which = np.repeat(np.arange(len(contexts)), count)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    # Windows match only under one gram at one distance from it.
    _, gram = np.unique(grams, return_inverse=True)
    group = gram[which] * (length + 1) + (distance[which] - inner)
    _, group, members = np.unique(group, return_inverse=True, return_counts=True)
    some = members[group] > 1
    which, inner, group = which[some], inner[some], group[some]
    suffixes = Suffixes(codes, starts_of[which] + inner, length)
    order = merge_sort(suffixes, group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    near = near[suffixes.common(a[near], b[near]) >= length]
    true = suffixes.same_bytes(a[near], b[near])
    hit = np.zeros(len(which), dtype=bool)
    hit[a[near[true]]] = hit[b[near[true]]] = True
    for g in np.unique(group[a[near[~true]]]):  # a hash lied: the bytes decide
        seen: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(group == g):
            at = suffixes.starts[k]
            seen.setdefault(codes[at : at + length].tobytes(), []).append(k)
        for members_ in seen.values():
            hit[members_] = len(members_) > 1
    low, high = np.full(len(contexts), 1 << 60, dtype=np.int64), np.full(len(contexts), -1, dtype=np.int64)
    np.minimum.at(low, which[hit], inner[hit])
    np.maximum.at(high, which[hit], inner[hit])
    return np.where(high < 0, -1, low), high


KIND = ("gram", "c1", "c2")
CONTEXTS = "gram long, c1 long, c2 long, t1 long, t2 long, lo long, distance long, often boolean, context binary"
DECIDED = "gram long, c1 long, c2 long, often boolean, t1 long, t2 long, a long, b long, proof binary"


def _contexts(length: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for t1, t2, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            data = text.as_buffer()
            out += [(w["gram"], w["c1"], w["c2"], t1, t2, w["lo"], w["anchor"] - w["lo"], w["often"], data[w["lo"] : w["hi"] + length].to_pybytes()) for w in wanted.as_py()]
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(CONTEXTS))

    return rows


def _sorted_repeats(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            *ids, t1, t2, lo, distance, often, contexts = zip(*held, strict=True)
            first, last = repeats(list(contexts), np.array(ids[0]), np.array(distance), length)
            lo, often = np.array(lo), np.array(often)
            whole = (first == 0) & (last == np.array([len(c) for c in contexts]) - length)
            keep = np.where(often, whole, first >= 0)
            columns = (*map(np.array, ids), often, np.array(t1), np.array(t2), lo + first, lo + last + length)
            proof = [sha256(c).digest() if o else None for c, o, k in zip(contexts, often, keep, strict=True) if k]
            return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), pa.array(proof, pa.binary())], names=_names(DECIDED))

        # Rows come in the order of their grams; a gram's are worked on together, with those of others up to SORT_BYTES.
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield done()

    return run


def _windows(length: int):
    """Two hashes of every window of a context."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = []
        for t1, t2, lo, often, context in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 7, 8)), strict=True):
            codes = np.frombuffer(context, dtype=np.uint8)
            at = np.arange(len(codes) - length + 1)
            hashes = [h.view(np.int64) for h in (between(prefix(codes), at, at + length), Residues(codes).between(at, at + length))]
            out.append([np.full(len(at), t1), np.full(len(at), t2), np.full(len(at), lo), at + lo, np.full(len(at), often), *hashes])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=_names(WINDOWS))

    return rows


WINDOWS = "t1 long, t2 long, lo long, at long, often boolean, h1 long, h2 long"


def _few(df: DataFrame, limit: int) -> DataFrame:
    """df, to be broadcast if a count shows that it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with t1, t2 (128 bits of the text) and _text, the text with null as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_text", whole).withColumn("t1", F.xxhash64("_text")).withColumn("t2", F.xxhash64(F.lit("second"), "_text"))


def _met(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """CONTEXTS of places (KIND, often, t1, t2, lo, hi, anchor). texts: t1, t2, _bytes."""
    wanted = places.groupBy("t1", "t2").agg(F.collect_list(F.struct(*KIND, "lo", "hi", "anchor", "often")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    some = texts.join(_few(wanted.select("t1", "t2"), BROADCAST_TEXTS), ["t1", "t2"], "left_semi")
    one = some.groupBy("t1", "t2").agg(F.first("_bytes").alias("_bytes"))
    return one.join(wanted, ["t1", "t2"]).select("t1", "t2", "_bytes", "wanted").mapInArrow(per_batch(_contexts(length)), CONTEXTS)


def _decided(met: DataFrame, length: int) -> DataFrame:
    """What the sort decides of contexts that meet by gram: the repeated range of each, of one that occurs often only if it is all repeated."""
    return materialise(met.repartition("gram").sortWithinPartitions("gram", "t1", "t2", "lo").mapInArrow(_sorted_repeats(length), DECIDED), "decided")


def _both(kinds: DataFrame) -> DataFrame:
    """The first and last place of kinds."""
    place = F.explode(F.array("first", "last")).alias("_p")
    return kinds.select(*KIND, F.lit(True).alias("often"), place).select(*KIND, "often", "_p.*")


def _hot(texts: DataFrame, kinds: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Kinds that the sort found repeated as a whole, and spans of the others, in grams of too many contexts to be gathered."""
    own = F.xxhash64(*KIND).alias("gram")
    frequent = kinds.where("n > 1 AND first <> last")
    # A kind's two places meet under its own hash; the gram is kept as distance from it.
    met = _met(texts, _both(frequent).select(own, F.col("gram").alias("c1"), *[F.col(c) for c in ("c2", "often", "t1", "t2", "lo", "hi", "anchor")]), length)
    whole = _decided(met, length).select(F.col("c1").alias("gram"), "c2", "proof").distinct()
    whole = frequent.join(whole, ["gram", "c2"]).select(*KIND, "proof")
    contexts = _met(texts, kinds.select(*KIND, (F.col("n") > 1).alias("often"), "first.*"), length)
    windows = materialise(contexts.mapInArrow(per_batch(_windows(length)), WINDOWS), "windows")
    place = F.struct("t1", "t2", F.col("at").alias("lo"), F.col("at").alias("hi"), F.col("at").alias("anchor"))
    twice = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    twice = twice.select(F.col("h1").alias("gram"), F.col("h2").alias("c1"), F.lit(0).cast("long").alias("c2"), "first", "last")
    sure = _decided(_met(texts, _both(twice), length), length).select(F.col("gram").alias("h1"), F.col("c1").alias("h2")).distinct()
    found = windows.where("NOT often").join(sure, ["h1", "h2"]).select("t1", "t2", "lo", "at").distinct()
    island = F.col("at") - F.row_number().over(Window.partitionBy("t1", "t2", "lo").orderBy("at"))  # a context has at most length - gram + 1 windows
    runs = found.withColumn("_island", island).groupBy("t1", "t2", "lo", "_island").agg(F.min("at").alias("a"), (F.max("at") + length).alias("b"))
    return whole, runs.select("t1", "t2", "a", "b")


def copies(docs: DataFrame, length: int) -> DataFrame:
    """One span over each text of `length` bytes or more that several rows of keyed() hold. SHA-256 must agree that it is one text."""
    sha = F.sha2("_text", 256)
    same = docs.where(F.octet_length("_text") >= length).groupBy("t1", "t2").agg(F.count("*").alias("_n"), F.min(sha).alias("_x"), F.max(sha).alias("_y"), F.max(F.octet_length("_text")).alias("b"))
    sure = F.when(F.col("_x") != F.col("_y"), F.raise_error(F.lit("two texts share 128 bits"))).otherwise(F.col("b"))
    return same.where("_n > 1").select("t1", "t2", F.lit(0).cast("long").alias("a"), sure.cast("long").alias("b"))


def _spread(places: DataFrame, whole: DataFrame) -> DataFrame:
    """The places of kinds that go whole. Too many kinds for a broadcast meet their places in SALTS deals, as one may have most of them."""
    if whole.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        return places.join(F.broadcast(whole), list(KIND))
    dealt = whole.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.withColumn("_deal", F.pmod(F.hash("t1", "t2", "lo"), F.lit(SALTS))).join(dealt, [*KIND, "_deal"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT_CONTEXTS) -> DataFrame:
    """t1, t2 of each text with repeats and `spans`, unmerged (a, b) byte ranges that cover them. docs: keyed()."""
    texts = docs.select("t1", "t2", F.col("_text").cast("binary").alias("_bytes")).where(F.octet_length("_bytes") >= length)
    cut = materialise(texts.mapInArrow(per_batch(_anchored(length)), RANGES), "ranges")
    place = F.struct("t1", "t2", "lo", "hi", "anchor")
    contexts = cut.groupBy(*KIND).agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    # A row each for the contexts of grams that occur twice; few of all, as most grams are unique.
    grams = contexts.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min("n").alias("least")).where("total > 1")
    shared = materialise(contexts.join(grams, "gram").select(*KIND, "n", "first", "last", "kinds", "least"), "shared")
    few, crowded = shared.where(F.col("kinds") <= hot), shared.where(F.col("kinds") > hot)

    # Windows of a context of its own meet those of all others under its gram. A context in copies of one text alone needs no proof of its own.
    often = few.where("n > 1 AND first <> last")
    single = few.where("least = 1 AND kinds > 1 AND (n = 1 OR first = last)").select(*KIND, F.lit(False).alias("often"), "first.*")
    decided = _decided(_met(texts, _both(often).unionByName(single), length), length)
    whole, spans = decided.where("often").select(*KIND, "proof").distinct(), decided.where("NOT often").select("t1", "t2", "a", "b")
    if crowded.limit(1).count():
        more, runs = _hot(texts, crowded, length)
        whole, spans = whole.unionByName(more), spans.unionByName(runs)
    # Copies of one text go whole, so their ranges need not be found again: a large group of them would meet in one task.
    same = materialise(copies(docs, length), "copies")
    others = cut.join(_few(same.select("t1", "t2"), BROADCAST_TEXTS), ["t1", "t2"], "left_anti")
    spread = _spread(others, materialise(whole, "whole")).select("t1", "t2", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"), "proof")
    sure = spans.unionByName(same).withColumn("proof", F.lit(None).cast("binary"))
    return spread.unionByName(sure).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b", "proof")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


CLEANED = "n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(names: list[str]):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, spans in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True):
            data, wanted = text.as_buffer(), spans.as_py()
            for s in wanted:
                if s["proof"] is not None and sha256(data[s["a"] : s["b"]]).digest() != s["proof"]:
                    raise ValueError("two contexts share 126 bits")
            runs = merged([(s["a"], s["b"]) for s in wanted])
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b].to_pybytes() for a, b in zip(edges[0::2], edges[1::2], strict=True))
            out.append((len(data), len(data) - len(kept), len(runs), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*names, *_names(CLEANED)])

    return rows


def dedup_strings(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), length: int = LENGTH, hot: int = HOT_CONTEXTS) -> DataFrame:
    """The given columns of each row of docs, n_bytes, n_removed, n_spans and kept, the bytes that are left."""
    rows = keyed(docs.select(*columns, "text"))
    spans = materialise(repeated_spans(rows, length, hot), "spans")
    keys = _few(spans.select("t1", "t2"), BROADCAST_TEXTS)
    touched = rows.join(keys, ["t1", "t2"], "left_semi").join(spans, ["t1", "t2"]).select(*columns, F.col("_text").cast("binary").alias("_bytes"), "spans")
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    cleaned = touched.mapInArrow(per_batch(_cut(list(columns))), f"{ddl}, {CLEANED}")
    zero = F.lit(0).cast("long")
    clean = rows.join(keys, ["t1", "t2"], "left_anti").select(*columns, F.octet_length("_text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("_text").cast("binary").alias("kept"))
    return clean.unionByName(cleaned)


def text_of(kept: Column) -> Column:
    """Bytes as text; of a character that lost some of its bytes U+FFFD is left."""
    return F.make_valid_utf8(kept.cast("string"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also kept_bytes, how many are left, and text, what they say (a character that lost some of its bytes is U+FFFD)."""
    rows = dedup_strings(table(spark, sf_dir, "documents"))
    left = [F.octet_length("kept").cast("long").alias("kept_bytes"), text_of(F.col("kept")).alias("text")]
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), *left)
