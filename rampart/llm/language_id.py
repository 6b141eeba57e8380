"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the training rows are summed per (language, bucket) by Spark. The matrix
of log probabilities is broadcast, BLOCK languages at a time (8 MB), and each Arrow
batch is scored as a sparse product: the n-gram ids of all its texts index rows of the
matrix, which are summed between text boundaries. With more than one block of
languages the rows are scored in as many passes, each of which carries the best
language so far and the sum of all weights; driver and tasks hold one block.

The model is fitted on about MAX_TRAIN_DOCS labelled rows drawn by a hash of the id,
as many of each language as a common level allows, and at least LANGUAGE_DOCS, so
that a rare language keeps its rows. Priors are of all labelled rows.

Defined cases: a null text, or one without a letter, is `und` with score 0.
Rows with a null language, a null id or a held-out id are never learned from.
With no row to learn from, every text is `und`. Repeated rows count as often as
they occur. Ties go to the language first in order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialise, per_batch, table, text_chunks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Expected number of labelled rows a model is fitted on, and the least for each language.
MAX_TRAIN_DOCS = 20_000
LANGUAGE_DOCS = 200
BLOCK = 64
BROADCAST_LANGUAGES = 100_000
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def ngram_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids [orders, characters] of the texts joined by NUL, and the first position of each text.

    An n-gram that meets a NUL has the id BUCKETS, which weighs nothing, so no n-gram crosses texts.
    """
    lowered = [(t or "").lower() for t in texts]
    starts = np.zeros(len(lowered), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in lowered[:-1]], out=starts[1:])
    codes = np.frombuffer(("\0".join(lowered) + "\0\0\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes) - 2
    blank = codes == 0
    ids, met, mixed = np.empty((len(ORDERS), n), dtype=np.int32), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.uint64)
    for k, order in enumerate(ORDERS):
        shifted = codes[order - 1 : order - 1 + n].astype(np.uint64)
        mixed = (mixed + shifted + np.uint64(order)) * _MULT[k]
        mixed ^= mixed >> np.uint64(29)
        met |= blank[order - 1 : order - 1 + n]
        ids[k] = np.where(met, BUCKETS, (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49))
    return ids, starts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class NaiveBayes:
    """Languages in order and a [BUCKETS + 1, languages] matrix of log probabilities. priors: the log prior of each."""

    def __init__(self, languages: list[str], counts: np.ndarray, priors: np.ndarray):
        smooth = counts + SMOOTHING
        matrix = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T if len(languages) else np.zeros((BUCKETS, 0))
        self.languages, self.prior = languages, priors
        self.matrix = np.vstack([matrix, np.zeros((1, len(languages)))]).astype(np.float32)

    def weights(self, texts: list[str | None]) -> np.ndarray:
        """Log weights [texts, languages]."""
        ids, starts = ngram_ids(texts)
        total = np.tile(self.prior, (len(texts), 1))
        for order in ids:
            total += np.add.reduceat(self.matrix[order], starts, axis=0, dtype=np.float64)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """As if these were all languages."""
        if not self.languages or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        total = self.weights(texts)
        best, score = total.argmax(axis=1), 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = [has_letter(t) for t in texts]
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def _count(batches):
    counts: dict[str, np.ndarray] = {}

    def done():
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(held[at], pa.int64())})
        counts.clear()

    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for first, texts in text_chunks(batch):
            ids, starts = ngram_ids(texts)
            ends = np.append(starts[1:], ids.shape[1])
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                if len(counts) >= BLOCK and langs[first + i] not in counts:
                    yield from done()
                held = counts.setdefault(langs[first + i], np.zeros(BUCKETS + 1, dtype=np.int64))
                held += np.bincount(ids[:, a:b].ravel(), minlength=BUCKETS + 1)
    yield from done()


@dataclass
class Model:
    """sums: lang, bucket, n of the sample. known: lang, n_docs of all labelled rows. total and size: rows and languages of known."""

    sums: DataFrame
    known: DataFrame
    total: int
    size: int
    block: int

    def blocks(self) -> Iterator[NaiveBayes]:
        """The languages in order, `block` at a time."""
        after = F.lit(True)
        while rows := self.known.where(after).orderBy("lang").limit(self.block).collect():
            languages = [r["lang"] for r in rows]
            got = self.sums.where((F.col("bucket") < BUCKETS) & F.col("lang").between(languages[0], languages[-1])).toPandas()
            counts = np.zeros((len(languages), BUCKETS))
            counts[got["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(dtype=np.int64), got["bucket"].to_numpy()] = got["n"].to_numpy()
            docs = np.array([r["n_docs"] for r in rows], dtype=np.float64)
            yield NaiveBayes(languages, counts, np.log((docs + 1.0) / (self.total + self.size)))
            after = F.col("lang") > languages[-1]


def sample_level(known: DataFrame, size: int, wanted: int) -> float:
    """The number of rows a language may give so that all give about `wanted`; it rises until no more languages give all they have."""
    level, before = wanted / max(size, 1), None
    while level != before:
        whole = F.col("n_docs") <= level
        s, k = known.agg(F.sum(F.when(whole, F.col("n_docs")).otherwise(0)), F.sum(F.when(whole, 0).otherwise(1))).first()
        before, level = level, max(level, (wanted - s) / k) if k else level
    return level


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, language_docs: int = LANGUAGE_DOCS, block: int = BLOCK) -> Model:
    """Fit on the labelled rows that are not held out, or on about `max_train_docs` of them drawn by a hash of the id."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = materialise(labelled.groupBy("lang").agg(F.count("*").alias("n_docs")), "languages")
    size, total = known.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    if total > max_train_docs:
        level = max(sample_level(known, size, max_train_docs), language_docs)
        part = known.where(F.col("n_docs") > 0).select("lang", F.least(F.lit(1.0), F.lit(level) / F.col("n_docs")).alias("_part"))
        part = F.broadcast(part) if size <= BROADCAST_LANGUAGES else part
        draw = F.pmod(F.xxhash64(F.lit("language-id"), "doc_id"), F.lit(1 << 30))
        labelled = labelled.join(part, "lang").where(draw < F.col("_part") * (1 << 30))
    sums = labelled.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(materialise(sums, "ngrams"), known, total, size, block)


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """row (the given columns of docs as a struct), lang_pred and score."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("_best"), F.lit(0.0).alias("_sum"))
    state = "lang_pred string, _best double, _sum double"
    for k, block in enumerate(model.blocks(), 1):
        last = k * model.block >= model.size
        held = docs.sparkSession.sparkContext.broadcast(block)
        names = columns if last else docs.columns

        def score(batch: pa.RecordBatch, held=held, names=tuple(names)) -> pa.RecordBatch:
            row, best_lang = batch.column(0), batch.column(1).to_pylist()
            best, total = batch.column(2).to_numpy(zero_copy_only=False).copy(), batch.column(3).to_numpy(zero_copy_only=False).copy()
            texts_of = pa.RecordBatch.from_arrays([row.field("text")], names=["text"])
            for at, texts in text_chunks(texts_of):
                some = [i for i, t in enumerate(texts) if has_letter(t)]
                if some:
                    found = held.value.weights([texts[i] for i in some])
                    i, top, which = np.array(some) + at, found.max(axis=1), found.argmax(axis=1)
                    new = np.maximum(best[i], top)
                    total[i] = total[i] * np.exp(best[i] - new) + np.exp(found - new[:, None]).sum(axis=1)
                    for j, b in zip(i[top > best[i]], which[top > best[i]], strict=True):
                        best_lang[j] = held.value.languages[b]
                    best[i] = new
            kept = pa.StructArray.from_arrays([row.field(c) for c in names], names=list(names))
            return pa.RecordBatch.from_arrays([kept, pa.array(best_lang, pa.string()), pa.array(best), pa.array(total)], names=["row", "lang_pred", "_best", "_sum"])

        ddl = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in names)
        rows = rows.mapInArrow(per_batch(score), f"row struct<{ddl}>, {state}")
        rows = rows if last else materialise(rows, "languages-scored")
    return rows.select(F.struct(*(F.col(f"row.`{c}`") for c in columns)).alias("row"), "lang_pred", F.when(F.col("_sum") > 0, 1 / F.col("_sum")).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"]).select("row.doc_id", "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they were, whose text is in a learned language with at least `min_score`."""
    found = scored(docs, fit(docs), docs.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select("row.*")
