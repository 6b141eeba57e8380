"""Quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are counts of its own characters and
those of the lines next to it. The field is fitted by gradient steps on a bounded
sample of labelled documents, each line taking its document's label; a document of
more lines than the whole sample may have is not drawn. Forward-backward gives each line's probability of being good; their mean, weighted by line
length, is the document's quality.

Forward-backward runs over all documents of a chunk at once, one step a line
number, over flat arrays, so a document of many lines costs no padding. Long documents
are cut into segments of SEGMENT lines, whose 2 x 2 products give the state at each
cut, so that a million lines take some thousands of steps and the same result.

Defined cases: a null or empty text is one empty line; with no labelled row to
learn from every score is the neutral 0.5; a document with several labels takes
their mean, rounded up at a half; null labels and null or held-out ids are never
learned from; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialise, per_batch, table, text_chunks

#: Expected number of labelled documents a model is fitted on; beyond it a hash of the id draws them.
MAX_TRAIN_DOCS = 2_000
#: Lines of the sample at most: 32 MB of features on the driver.
MAX_TRAIN_LINES = 200_000
SEGMENT = 1024
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 80, 0.15, 1e-3


def _classes() -> np.ndarray:
    """For each byte whether it starts a character, is a symbol, other mark, digit, capital, letter or space."""
    t = np.zeros((7, 256), dtype=np.uint8)
    t[0] = 1
    t[0, 0x80:0xC0] = 0
    t[0, 10] = 0
    t[1, list(b"#*$%&|<>{}[]\\^~=+_@`")] = 1
    t[2, list(b"!\"'(),-./:;?")] = 1
    t[3, list(b"0123456789")] = 1
    t[4, 65:91] = 1
    t[5, 65:91] = t[5, 97:123] = t[5, 0xC0:] = 1
    t[6, [9, 11, 12, 13, 32]] = 1
    return t


_CLASS = _classes()
_OWN = 10
N_FEATURES = _OWN + 2 * 5


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [lines, N_FEATURES], characters of each line, and the first line of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(codes == 10)
    starts = np.append(0, ends[:-1] + 1)
    lines = np.array([r.count(b"\n") + 1 for r in raw])
    first = np.append(0, np.cumsum(lines)[:-1])
    sums = [np.add.reduceat(c[codes], starts, dtype=np.int64).astype(np.float32) for c in _CLASS]
    gap = (_CLASS[6][codes] | (codes == 10)).astype(bool)
    words = np.add.reduceat(~gap & np.append(True, gap[:-1]), starts, dtype=np.int64).astype(np.float32)
    again = np.zeros(len(ends), dtype=np.float32)
    for r, at, n in zip(raw, first, lines, strict=True):
        if n > 1:
            seen: set[bytes] = set()
            for k, line in enumerate(r.split(b"\n")):
                again[at + k] = line in seen
                seen.add(line)
    chars, some = sums[0], np.maximum(sums[0], 1)
    own = np.empty((len(ends), _OWN), dtype=np.float32)
    own[:, 0] = sums[1] / some
    own[:, 1] = sums[2] / some
    own[:, 2] = sums[3] / some
    own[:, 3] = np.log1p(chars)
    own[:, 4] = again
    own[:, 5] = sums[4] / np.maximum(words, 1)
    own[:, 6] = sums[5] / some
    own[:, 7] = np.minimum(chars / np.maximum(words, 1), 40)
    own[:, 8] = sums[1] > words / 4
    own[:, 9] = chars == 0
    near = np.zeros((len(ends), 2, 5), dtype=np.float32)
    near[1:, 0], near[:-1, 1] = own[:-1, :5], own[1:, :5]
    near[first, 0] = 0
    near[first + lines - 1, 1] = 0
    return np.hstack([own, near.reshape(len(ends), 10)]), chars, first


def _scan(weight: np.ndarray, step: np.ndarray, first: np.ndarray, into: np.ndarray, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward weights of chains of lines, and each line's scale.

    into: the weights before each chain's first line (all ones halves where it starts a text, with no move). out: those after its last, else ones.
    """
    n = len(weight)
    ends = np.append(first[1:], n)
    order = np.argsort(first - ends, kind="stable")
    start, lines = first[order], (ends - first)[order]
    ahead, back, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    ahead[start] = into[order] * weight[start]
    scale[start] = ahead[start].sum(axis=1)
    ahead[start] /= scale[start, None]
    active = [np.searchsorted(-lines, -t, side="left") for t in range(1, int(lines[0]) if len(lines) else 0)]
    for t, k in enumerate(active, 1):
        at = start[:k] + t
        now = (ahead[at - 1] @ step) * weight[at]
        scale[at] = now.sum(axis=1)
        ahead[at] = now / scale[at, None]
    if out is not None:
        last = ends - 1
        back[last] = out / (ahead[last] * out).sum(axis=1, keepdims=True)
    for t, k in reversed(list(enumerate(active, 1))):
        at = start[:k] + t
        back[at - 1] = (weight[at] * back[at]) @ step.T / scale[at, None]
    return ahead, back, scale


def _cuts(weight: np.ndarray, step: np.ndarray, first: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights before the first and after the last line of each segment. heads: which segments start a text."""
    ends = np.append(first[1:], len(weight))
    product = np.tile(np.eye(2), (len(first), 1, 1))
    for t in range(int((ends - first).max())):
        some = np.flatnonzero(first + t < ends)
        move = np.where((heads[some] & (t == 0))[:, None, None], np.eye(2), step) * weight[first[some] + t][:, None, :]
        product[some] = product[some] @ move
        product[some] /= product[some].sum(axis=(1, 2), keepdims=True)
    into, out = np.ones((len(first), 2)), np.ones((len(first), 2))
    held = np.ones(2)
    for k in range(len(first)):
        held = np.ones(2) if heads[k] else held
        into[k] = held if heads[k] else held @ step
        held = held @ product[k]
        held = held / held.sum()
    for k in range(len(first) - 2, -1, -1):
        if not heads[k + 1]:
            held = product[k + 1] @ out[k + 1]
            out[k] = held / held.sum()
    return into, out


def forward_backward(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability that each line is good, and of each text the expected moves [2, 2] and the log of the partition sum.

    emit: each line's log weight of good over bad. move: log weights from state to state.
    """
    n = len(emit)
    ends = np.append(first[1:], n)
    weight = np.stack([np.exp(-np.maximum(emit, 0)), np.exp(np.minimum(emit, 0))], axis=1)  # scaled: the larger is 1
    step = np.exp(move)
    pieces = -(-(ends - first) // SEGMENT)
    if (pieces > 1).any():
        heads = np.zeros(pieces.sum(), dtype=bool)
        heads[np.cumsum(pieces) - pieces] = True
        starts = np.repeat(first - (np.cumsum(pieces) - pieces) * SEGMENT, pieces) + np.arange(len(heads)) * SEGMENT
        ahead, back, scale = _scan(weight, step, starts, *_cuts(weight, step, starts, heads))
    else:
        ahead, back, scale = _scan(weight, step, first, np.ones((len(first), 2)), None)
    good = ahead * back
    good = good[:, 1] / good.sum(axis=1)
    later = np.ones(n, dtype=bool)
    later[first] = False
    at = np.flatnonzero(later)
    pairs = ahead[at - 1][:, :, None] * step * ((weight[at] * back[at]) / scale[at, None])[:, None, :]
    text = np.repeat(np.arange(len(first)), ends - first)
    moves = np.zeros((len(first), 2, 2))
    np.add.at(moves, text[at], pairs)
    return good, moves, np.bincount(text, np.log(scale) + np.maximum(emit, 0), len(first))


@dataclass
class Field:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray

    def emit(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.spread) @ self.weights + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        features, chars, first = line_features(texts)
        good, _, _ = forward_backward(self.emit(features), self.move, first)
        size = chars + 1.0
        return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def objective(theta: np.ndarray, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean over documents of the log likelihood of their lines' labels a line, less the ridge; and its gradient.

    theta: weights of the features, bias, the four moves. Each document weighs the same, whatever its number of lines.
    """
    lines = np.diff(np.append(first, len(x)))
    y, by_line = np.repeat(labels, lines), np.repeat(1.0 / lines, lines)
    seen = np.zeros((len(first), 2, 2))
    seen[np.arange(len(first)), labels, labels] = lines - 1
    move, emit = theta[-4:].reshape(2, 2), x @ theta[:-5] + theta[-5]
    good, moves, log = forward_backward(emit, move, first)
    off = (y - good) * by_line
    grad = np.concatenate([x.T @ off, [off.sum()], ((seen - moves) / lines[:, None, None]).sum(axis=0).ravel()]) / len(first) - RIDGE * theta
    path = np.add.reduceat(y * emit, first) + (seen * move).sum(axis=(1, 2))
    return float(((path - log) / lines).mean() - RIDGE / 2 * theta @ theta), grad


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    """Fit by Adam."""
    mean, spread = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-3)
    x = (features - mean) / spread
    theta = np.zeros(features.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, grad = objective(theta, x, first, labels)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(mean, spread, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_lines: int = MAX_TRAIN_LINES) -> Field | None:
    """Fit on labelled documents that are not held out, or about `max_train_docs` of them drawn by a hash of the id, with `max_train_lines` lines at most."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    n = known.count()
    if n > max_train_docs:
        known = known.where(F.pmod(F.xxhash64(F.lit("quality-crf"), "doc_id"), F.lit(1 << 30)) < int(max_train_docs / n * (1 << 30)))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[bytes] = []
        for _, texts in text_chunks(batch):
            features, _, first = line_features(texts)
            found += [features[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(features)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    # The sample's size is bounded above, so its ids may be broadcast. Of repeated ids the least text is learned from.
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    drawn = materialise(drawn, "quality-sample")
    sizes = drawn.select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), F.xxhash64(F.lit("lines"), "doc_id").alias("turn")).collect()
    left, chosen = max_train_lines, []
    for r in sorted(sizes, key=lambda r: r["turn"]):
        if r["lines"] <= left:
            chosen.append(r["doc_id"])
            left -= r["lines"]
    if len(chosen) < len(sizes):
        drawn = drawn.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id", "left_semi")
    got = sorted(drawn.select("doc_id", "label", "text").mapInArrow(per_batch(rows), "doc_id long, label int, features binary").collect(), key=lambda r: r["doc_id"])
    if not got:
        return None
    parts = [np.frombuffer(r["features"], dtype=np.float32).reshape(-1, N_FEATURES) for r in got]
    first = np.append(0, np.cumsum([len(p) for p in parts])[:-1])
    return train(np.vstack(parts).astype(np.float64), first, np.array([r["label"] for r in got]))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and score of each document."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        values: list[float] = []
        for _, texts in text_chunks(batch):
            values += [0.5] * len(texts) if held.value is None else held.value.score(texts).tolist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch(rows), "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
