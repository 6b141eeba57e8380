"""How far the sources of a language are apart in their words: smoothed term probabilities, compared pair by pair.

Texts are counted in one Arrow pass that holds a bounded table of sums and emits rows
(lang, source, term, documents, occurrences). One shuffle by (lang, term) turns them
into an inverted index, of which the terms in at least MIN_DOCS documents of their
language are kept.

The distance of two sources sums |p - q| over all V kept terms. Most terms are in
neither source or in one of them, so it is put together from corrections:

* every pair starts at V times the distance of two zero counts;
* a term of one source is compared with the other's zero count. Terms of a source with
  the same probability are counted together first, so that each source meets the
  others once for each of its probabilities, not once for each of its terms;
* postings of a term in both sources emit what these two corrections got wrong, if
  anything.

No term is paired with a source that lacks it, and nothing is collected: pairs of
postings come from a sort-merge join of the index with itself, summed before they are
shuffled. All numbers are whole; probabilities are divided as decimals.

Defined cases: a null text has no terms; null lang and source are ''; a group without
terms is compared by its zero counts; a language without kept terms has distances of 0
and no term rows; repeated rows count as documents each; texts of any length are
counted in pieces; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Fixed value: what a term is made of. A-Z are lower-cased before.
TERM = "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"
#: Sums that a task holds before it passes them on.
HELD_TERMS = 300_000
#: Characters of a text that are split at a time.
PIECE = 1_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}
COUNTED = "lang string, source string, term string, docs long, n long"


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end at a character outside of terms."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and not (text[end] < "\x80" and not text[end].isalpha()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial sums (lang, source, term, docs, n): one row a task for most terms, never more than the texts hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, total) in groups.items():
                terms = list(total)
                for a in range(0, len(terms), 20_000):
                    part = terms[a : a + 20_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part), pa.array([seen[t] for t in part], pa.int64()), pa.array([total[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                seen, total = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                own: Counter = Counter()
                for piece in _pieces(text.as_py()):
                    own.update(find(piece.translate(_LOWER) if piece.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), piece)))
                before = len(total)
                total.update(own)
                seen.update(own.keys())
                held += len(total) - before
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*_group(), text.alias("text")).mapInArrow(run, COUNTED)


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _p(count: str, total: str) -> Column:
    """1 + floor(SCALE (count + SMOOTHING) / (total + SMOOTHING V)), in whole numbers."""
    wide = lambda x: f"CAST({x} AS DECIMAL(19,0))"
    return F.expr(f"1 + ({SCALE} * ({wide(count)} + {SMOOTHING})) DIV ({wide(total)} + {SMOOTHING} * {wide('v')})")


def index(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The kept terms' postings (lang, term, source, n), with lang_n, the term's count in the language, and first, true for one posting of each term."""
    term = Window.partitionBy("lang", "term")
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = summed.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.col("source") == F.min("source").over(term)})
    return whole.where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "first")


def pair_distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language. groups: lang, source, v, p0; postings: lang, term, source, p, p0."""
    off = lambda a, b: F.abs(F.col(a) - F.col(b))
    zero = off("p0", "o0")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    pairs = groups.join(others, "lang").where("source < item")
    base = pairs.select("lang", "source", "item", (F.col("v") * zero).alias("value"))
    steps = postings.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("terms"))
    alone = steps.join(others, "lang").where("source <> item").groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(
        F.sum(F.col("terms") * (off("p", "o0") - zero)).alias("value")
    )
    other = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    mend = off("p", "o") - off("p", "o0") - off("p0", "o") + zero
    both = postings.join(other, ["lang", "term"]).where("source < item").select("lang", "source", "item", mend.alias("value")).where("value <> 0")
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by distance (part 'pair') and terms above the language's share (part 'term')."""
    kept = materialise(index(docs, min_docs), "terms")
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*_group()).distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "total"])
    groups = materialise(groups.select("lang", "source", "v", "total", "lang_total", F.when(F.col("v") > 0, _p("0", "total")).otherwise(0).alias("p0")), "groups")
    postings = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "p0", _p("n", "total").alias("p"), _p("lang_n", "lang_total").alias("q"), "n")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(groups, postings).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    above = postings.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), lt AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT s.lang, s.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * lt.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (lt.lang_total + 5 * lt.v) AS q
  FROM g JOIN lt USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 50
"""
