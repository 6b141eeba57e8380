"""Near-duplicates by an LSH forest over MinHash signatures.

A document is the set of its distinct shingles. TREES trees each order the sets
by DEPTH minimum hashes of their own. In every tree, sets with MIN_DEPTH leading
values in common form a region; there, each set is compared with the WINDOW sets
that follow it in sorted order, which are those with the longest common prefixes.
So the depth that matters adapts to a region: in a crowded one neighbours agree to
the last value, in a sparse one MIN_DEPTH is enough.

In any region larger than the window each set is also compared with the PIVOTS most
central ones, those that agree most with the commonest value at each place of the
key. A crowd of copies of one text thus meets through that text and the copies nearest
to it. All other pairs that are not yet joined meet by their rarest members
(rest_links), so that a region is exact, whatever its size.

A region of more than REGION_SETS sets (or REGION_SHINGLES shingles) is cut into
blocks by a hash, and every two blocks make a part, so that each pair of the region
meets in one part at least. A set goes to one part fewer than there are blocks.

All comparisons are of full sets, made where the sets of a region lie, and only a
spanning forest of the links found leaves a task. Equal sets are one set from the
start. Two sets at exactly the threshold that are alone in their regions are missed
with probability (1 - 0.8^MIN_DEPTH)^TREES, under 1 in 200,000.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case.
Shingles are compared by 64-bit hashes and whole sets by 128 bits.

Defined cases: a text with fewer words than a shingle is one shingle of them all; a
null, empty or blank text has no shingle and is linked with nothing; a null id is
its own component, null, and is kept; repeated rows share a component and are both
kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, per_batch, table, text_chunks
from .components import components
from .hashing import U64, Residues, mix

TREES, DEPTH, MIN_DEPTH = 12, 5, 2
PLACES = TREES * DEPTH
WINDOW = 10
PIVOTS = 64
REGION_SETS, REGION_SHINGLES = 2_000, 2_000_000
#: Pairs looked at in one go in a crowded region.
CANDIDATES = 1_000_000
BROADCAST_IDS = 1_000_000
_WORD = U64(0x9E3779B97F4A7C15)
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, PLACES, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    codes = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.append(0, edge)
    start, end = edge[0::2], edge[1::2]
    words = Residues(codes).between(start, end)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(start, bounds)
    rolled = words.copy()
    for k in range(1, min(size, len(words))):
        rolled[: len(words) - k] = rolled[: len(words) - k] * _WORD + words[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole ^ words[k : k + 1]) * _WORD
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes [sets, PLACES] of sets that aren't empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), PLACES), dtype=">u4")
    for k, seed in enumerate(_SEEDS):
        x = flat * seed
        out[:, k] = np.minimum.reduceat((x ^ (x >> U64(29))) * _WORD >> U64(32), first)
    return out


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, signature binary"


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Set size, 128 bits of the set and signature of each row; nulls for an empty set."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, f1, f2, signed = [], [], [], []
        for _, texts in text_chunks(batch):
            sets = shingle_sets(texts, size)
            n += [len(s) for s in sets]
            prints = [_prints(s) if len(s) else (None, None) for s in sets]
            f1 += [p for p, _ in prints]
            f2 += [p for _, p in prints]
            some = signatures([s for s in sets if len(s)]) if any(map(len, sets)) else []
            each = iter(some)
            signed += [next(each).tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(signed, pa.binary())], names=[c.split()[0] for c in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch(rows), SKETCH)


def _prints(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return int(members.sum().view(np.int64)), int(mix(members ^ _WORD).sum().view(np.int64))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for _, texts in text_chunks(batch) for s in shingle_sets(texts, size)]
        prints = [_prints(s) for s in found]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "f1", "f2", "members"])

    return docs.mapInArrow(per_batch(rows), "rep long, f1 long, f2 long, members binary")


class Forest:
    """Union-find over the sets of one part; the links that joined them."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def alike(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def part_links(keys: list[bytes], sets: list[np.ndarray], pivots: list[int], percent: int, exact: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links found among sets in the order of their keys. pivots: which of them every set is compared with. exact: or of all links there are."""
    forest, sizes = Forest(len(sets)), [len(s) for s in sets]
    shallow = 4 * MIN_DEPTH
    for i in range(len(sets)):
        for j in range(i + 1, min(i + 1 + WINDOW, len(sets))):
            if keys[i][:shallow] != keys[j][:shallow]:
                break
            if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]) and forest.root(i) != forest.root(j):
                both = np.concatenate([sets[i], sets[j]])
                both.sort()
                if alike(int((both[1:] == both[:-1]).sum()), sizes[i], sizes[j], percent):
                    forest.link(i, j)
    if pivots:
        vocabulary = np.unique(np.concatenate([sets[p] for p in pivots]))
        inside = np.zeros((len(vocabulary) + 1, len(pivots)), dtype=np.uint8)
        for k, p in enumerate(pivots):
            inside[np.searchsorted(vocabulary, sets[p]), k] = 1
        for i in range(len(sets)):
            far = [k for k, p in enumerate(pivots) if forest.root(p) != forest.root(i)]
            if far:
                at = np.minimum(np.searchsorted(vocabulary, sets[i]), len(vocabulary) - 1)
                both = inside[at[vocabulary[at] == sets[i]]].sum(axis=0, dtype=np.int64)
                for k in far:
                    if alike(int(both[k]), sizes[i], sizes[pivots[k]], percent):
                        forest.link(i, pivots[k])
    if exact and len(sets) > WINDOW:
        rest_links(forest, sets, percent)
    return forest.links


def rest_links(forest: Forest, sets: list[np.ndarray], percent: int) -> None:
    """Join the sets of a part that are alike and not yet joined, whichever they are.

    Two sets that are alike share one of the rarest members of each; the order of members is by how many sets hold
    them. Where such a member lies bounds how much two sets share, which leaves few pairs of a crowd to compare.
    """
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], dtype=np.int64)
    roots = lambda: np.array([forest.root(int(i)) for i in order], dtype=np.int64)
    root = roots()
    if (root == root[0]).all():
        return
    owner = np.repeat(np.arange(n), size)
    values, token, held = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(values))
    lowest, highest = np.full(len(values), n), np.full(len(values), -1)
    np.minimum.at(lowest, token, root[owner])
    np.maximum.at(highest, token, root[owner])
    apart = np.empty(len(values), dtype=bool)  # members that sets not yet joined have in common
    apart[rank] = lowest < highest
    token = np.sort(owner * len(values) + rank[token]) - owner * len(values)
    place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    length = size[owner]
    # Of two sets that are alike, the larger shares at least percent of its own members, the smaller more of its own.
    probes = np.flatnonzero((place <= length - -(-percent * length // 100)) & apart[token])
    listed = np.flatnonzero((place <= length - -(-2 * percent * length // (100 + percent))) & apart[token])
    largest = np.bincount(root).argmax()
    of_largest = root[owner[listed]] == largest
    smallest = np.searchsorted(size, -(-percent * size // 100))
    for index, asking in ((listed[~of_largest], probes), (listed[of_largest], probes[root[owner[probes]] != largest])):
        index = index[np.argsort(token[index] * n + owner[index])]
        keys = token[index] * n + owner[index]
        x = owner[asking]
        # A member at this place leaves so many in common at most, and so bounds the smaller set's size.
        most = (100 + percent) * (length[asking] - place[asking]) // percent - length[asking]
        first = np.searchsorted(keys, token[asking] * n + smallest[x])
        last = np.searchsorted(keys, token[asking] * n + np.minimum(x, np.searchsorted(size, most, side="right")))
        count = np.maximum(last - first, 0)
        ends = np.cumsum(count)
        a = 0
        while a < len(asking):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, side="right")))
            if ends[b - 1] > (ends[a - 1] if a else 0):
                p = np.repeat(np.arange(a, b), count[a:b])
                q = index[first[p] + np.arange(len(p)) - np.repeat(ends[a:b] - count[a:b] - (ends[a - 1] if a else 0), count[a:b])]
                i, j = x[p], owner[q]
                shared = np.minimum(length[asking[p]] - place[asking[p]], length[q] - place[q])
                fits = (root[i] != root[j]) & ((100 + percent) * shared >= percent * (size[i] + size[j]))
                for pair in np.unique(i[fits] * n + j[fits]).tolist():
                    s, t = int(order[pair // n]), int(order[pair % n])
                    if forest.root(s) != forest.root(t):
                        both = np.concatenate([sets[s], sets[t]])
                        both.sort()
                        if alike(int((both[1:] == both[:-1]).sum()), len(sets[s]), len(sets[t]), percent):
                            forest.link(s, t)
                if fits.any():
                    root = roots()
            a = b


def agreement(signature: np.ndarray, common: np.ndarray) -> np.ndarray:
    return (signature == common).sum(axis=-1)


def commonest(signature: np.ndarray) -> np.ndarray:
    """The most frequent value at each place, the smaller of equals."""
    out = np.empty(signature.shape[1], dtype=signature.dtype)
    for k in range(signature.shape[1]):
        values, n = np.unique(signature[:, k], return_counts=True)
        out[k] = values[n.argmax()]
    return out


def _parts(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns[:5]]
                for k, members in enumerate(batch.column(5)):
                    yield tuple(c[k] for c in cols), members

        a: list[int] = []
        b: list[int] = []
        # tree, region, part, key, rep; sorted by these
        for _, group in groupby(rows(), key=lambda r: r[0][:3]):
            held = list(group)
            sets = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for _, m in held]
            reps = [h[4] for h, _ in held]
            pivots: list[int] = []
            if len(held) > WINDOW + 1:
                signed = np.frombuffer(b"".join(h[3] for h, _ in held), dtype=">u4").reshape(len(held), DEPTH)
                pivots = np.lexsort((reps, -agreement(signed, commonest(signed))))[:PIVOTS].tolist()
            links = part_links([h[3] for h, _ in held], sets, pivots, percent, exact=True)
            a += [reps[i] for i, _ in links]
            b += [reps[j] for _, j in links]
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _few(df: DataFrame, limit: int) -> DataFrame:
    """df, to be broadcast if a count shows that it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def links(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links a, b among the representatives (rep, n_shingles, signature) of docs' distinct sets."""
    at = lambda tree, depth: F.substring("signature", 4 * DEPTH * tree + 1, 4 * depth)
    trees = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(at(t, MIN_DEPTH)).alias("region")) for t in range(TREES)))
    rows = reps.select("rep", "n_shingles", F.explode(trees).alias("_t")).select("rep", "n_shingles", "_t.tree", "_t.region")
    crowds = rows.groupBy("tree", "region").agg(F.count("*").alias("_sets"), F.sum("n_shingles").alias("_size")).where("_sets > 1")
    blocks = F.greatest(F.ceil(F.col("_sets") / REGION_SETS), F.ceil(F.col("_size") / REGION_SHINGLES)).cast("int")
    crowds = materialise(crowds.withColumn("_blocks", blocks).select("tree", "region", "_blocks"), "regions")
    met = materialise(rows.join(crowds, ["tree", "region"]).select("tree", "region", "rep", "_blocks"), "met")

    # A part for each two blocks, numbered lower * blocks + higher; a region of one block is one part.
    block = F.pmod(F.xxhash64("tree", "rep"), F.col("_blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: (k != F.col("_block")) | (F.col("_blocks") == 1))
    part = lambda k: F.least(k, "_block").cast("long") * F.col("_blocks") + F.greatest(k, "_block")
    placed = met.withColumn("_block", block).select("tree", "region", "rep", F.explode(F.transform(others, part)).alias("part"))
    needed = met.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep IS NOT NULL")
    sets = _sets(texts.join(_few(needed, BROADCAST_IDS), "rep", "left_semi"), size)
    # Repeated rows are one set; a repeated id with another text is another set of the same node.
    full = sets.groupBy("rep", "f1", "f2").agg(F.first("members").alias("members")).join(reps.select("rep", "f1", "f2", "signature"), ["rep", "f1", "f2"])
    key = F.expr(f"substring(signature, {4 * DEPTH} * tree + 1, {4 * DEPTH})")
    ready = placed.join(full, "rep").select("tree", "region", "part", key.alias("key"), "rep", "members")
    return ready.repartition("tree", "region", "part").sortWithinPartitions("tree", "region", "part", "key", "rep").mapInArrow(_parts(percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each of docs: doc_id, n_shingles, component_id and kept."""
    sketched = materialise(sketch(docs, size), "sketch")
    reps = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    reps = materialise(reps, "sets")
    found = components(links(docs, reps, size, percent))
    of_set = reps.join(found, reps["rep"] == found["node"], "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    rows = sketched.select("doc_id", "n_shingles", "f1", "f2").join(of_set, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents in, one document of each group of near-duplicates out."""
    drop = near_duplicates(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


#: Shingle sets in full, one of each kind; links of all pairs that share a shingle; reachability along links.
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM w),
d AS (SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep FROM l),
h AS (SELECT doc_id, n, unnest(s) AS g FROM d WHERE doc_id = rep),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT DISTINCT rep AS x, rep AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, d.n AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.x = d.rep"""
