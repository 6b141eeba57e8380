"""Quality rules as weak supervision. DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns (3 to the number of rules at most, so what the
driver sees is bounded) estimates the share of good documents and, for each rule,
how often it votes either way or abstains on good and on bad ones: its accuracy by
class. Nothing is clamped, so each round raises the posterior density of the estimates;
the priors say which class is which. The log odds of "good" are then a sum over the
rules, which is a plain column. A document is kept if the posterior is at least KEEP_FROM
and it passes the base rules.

Words are runs of bytes other than space and 0x09-0x0D. Windows of eight words
are compared by 64-bit hashes within one text.

Defined cases: a null or empty text has no words and fails the base rules;
repeated rows vote once each; an empty table gives an empty one and is fitted to
the prior; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5
ROUNDS = 50
#: Pseudo-counts that estimation starts from: documents that are bad and good, and by class (0 bad, 1 good) each rule's votes.
#: A bad document draws a bad vote from some rules only, so "good" says little and "bad" says much.
PRIOR_DOCS = (5.0, 5.0)
PRIOR_VOTES = {0: {-1: 2.5, 0: 1.5, 1: 6.0}, 1: {-1: 0.2, 0: 1.8, 1: 8.0}}
_SPACE = "[\\x20\\x09-\\x0D]+"


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("_t"))
    split = base.select(
        "doc_id",
        F.filter(F.split("_t", _SPACE, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[^\\p{L}\\p{M}\\x20\\x09-\\x0D]+")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_t", _SPACE, "")).cast("long").alias("word_chars"),
    )
    counted = split.select(
        "doc_id", "n_symbols", "n_marks", "word_chars",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    starts = F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    held = counted.withColumn("_windows", windows).drop("_hashes")
    held = held.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    at = lambda k: F.get("_sorted", k)["h"]
    twice = F.filter("_sorted", lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False)))
    held = held.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return held.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, as columns over features(). All compare whole numbers."""
    c = F.col
    return {
        "length": _vote(c("n_words") >= 50, c("n_words") < MIN_WORDS),
        "word_size": _vote((c("word_chars") * 10 >= c("n_words") * 30) & (c("word_chars") <= c("n_words") * 9), (c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 14)),
        "symbols": _vote(c("n_symbols") * 100 <= c("n_words") * 5, c("n_symbols") * 100 > c("n_words") * 30),
        "marks": _vote(c("n_marks") * 100 <= c("n_words") * 50, c("n_marks") * 100 > c("n_words") * 80),
        "lines": _vote(c("n_dup_lines") * 100 <= c("n_lines") * 5, c("n_dup_lines") * 100 > c("n_lines") * 30),
        "repeats": _vote(c("n_repeat_words") * 100 <= c("n_words") * 5, c("n_repeat_words") * 100 > c("n_words") * 20),
    }


Rates = list[dict[int, dict[int, float]]]


def estimates(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, Rates]:
    """Share of good documents, and how often each rule casts each vote by class."""
    share, start = PRIOR_DOCS[1] / sum(PRIOR_DOCS), {c: {v: n / sum(PRIOR_VOTES[c].values()) for v, n in PRIOR_VOTES[c].items()} for c in (0, 1)}
    rates = [start] * n_rules
    for _ in range(rounds):
        weights = _weights(rates)
        docs, cast = list(PRIOR_DOCS), [{c: dict(PRIOR_VOTES[c]) for c in (0, 1)} for _ in range(n_rules)]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(share, weights, votes)))))
            for c, part in ((1, n * p), (0, n * (1 - p))):
                docs[c] += part
                for j, v in enumerate(votes):
                    cast[j][c][v] += part
        share = docs[1] / sum(docs)
        rates = [{c: {v: n / sum(by[c].values()) for v, n in by[c].items()} for c in (0, 1)} for by in cast]
    return share, rates


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Share of good documents, and for each rule and vote the log of how much likelier good documents get it."""
    share, rates = estimates(patterns, n_rules, rounds)
    return share, _weights(rates)


def _weights(rates: Rates) -> list[dict[int, float]]:
    """Log ratios of the classes' rates."""
    return [{v: math.log(by[1][v] / by[0][v]) for v in (-1, 0, 1)} for by in rates]


def log_odds(share: float, weights: list[dict[int, float]], votes: tuple[int, ...]) -> float:
    return math.log(share / (1 - share)) + sum(w[v] for v, w in zip(votes, weights, strict=True))


def label(counts: DataFrame) -> DataFrame:
    """features() with base_failed, posterior and kept."""
    votes = rules()
    got = counts.groupBy(*(v.alias(k) for k, v in votes.items())).count().collect()
    share, weights = expectation_maximisation(sorted((tuple(r[k] for k in votes), r["count"]) for r in got), len(votes))
    odds = F.lit(math.log(share / (1 - share)))
    for vote, w in zip(votes.values(), weights, strict=True):
        odds = odds + F.when(vote == -1, F.lit(w[-1])).when(vote == 1, F.lit(w[1])).otherwise(F.lit(w[0]))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return counts.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialise(features(table(spark, sf_dir, "documents")), "quality-features")
    return label(counts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


#: The votes of rules(), in its order: (good, bad).
_SQL_VOTES = (
    ("n_words >= 50", f"n_words < {MIN_WORDS}"),
    ("word_chars * 10 >= n_words * 30 AND word_chars <= n_words * 9", "word_chars < n_words * 2 OR word_chars > n_words * 14"),
    ("n_symbols * 100 <= n_words * 5", "n_symbols * 100 > n_words * 30"),
    ("n_marks * 100 <= n_words * 50", "n_marks * 100 > n_words * 80"),
    ("n_dup_lines * 100 <= n_lines * 5", "n_dup_lines * 100 > n_lines * 30"),
    ("n_repeat_words * 100 <= n_words * 5", "n_repeat_words * 100 > n_words * 20"),
)


def _oracle() -> str:
    """Windows as strings; estimation as a recursion over one row, whose lists hold each rule's rates of the votes -1, 0, 1 by class."""
    n = len(_SQL_VOTES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (good, bad) in enumerate(_SQL_VOTES))
    names = ", ".join(f"v{j}" for j in range(n))
    odds = "ln(share / (1 - share)) + " + " + ".join(f"ln(r1[{3 * j + 2} + v{j}] / r0[{3 * j + 2} + v{j}])" for j in range(n))
    start = {c: "[" + ", ".join(f"{PRIOR_VOTES[c][v]}::DOUBLE / {sum(PRIOR_VOTES[c].values())}" for _ in range(n) for v in (-1, 0, 1)) + "]" for c in (0, 1)}
    part = {1: "n * p", 0: "n * (1 - p)"}
    rates = {c: "[" + ", ".join(f"({PRIOR_VOTES[c][v]} + sum(CASE WHEN v{j} = {v} THEN {part[c]} ELSE 0 END)) / ({sum(PRIOR_VOTES[c].values())} + sum({part[c]}))" for j in range(n) for v in (-1, 0, 1)) + "]" for c in (0, 1)}
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS n FROM g),
o AS (SELECT doc_id, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {WINDOW})) AS fresh FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(fresh)::BIGINT AS n_repeat_words FROM o GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '[^\\p{{L}}\\p{{M}}\\x20\\x09-\\x0D]+'))::BIGINT AS n_marks, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
v AS MATERIALIZED (SELECT *, {votes} FROM f),
p AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
e AS (
  SELECT 0 AS k, {PRIOR_DOCS[1]}::DOUBLE / {sum(PRIOR_DOCS)} AS share, {start[0]} AS r0, {start[1]} AS r1
  UNION ALL
  SELECT k + 1, ({PRIOR_DOCS[1]} + sum(n * p)) / ({sum(PRIOR_DOCS)} + sum(n)), {rates[0]}, {rates[1]}
  FROM (SELECT k, n, {names}, 1 / (1 + exp(-({odds}))) AS p FROM e, p WHERE k < {ROUNDS}) GROUP BY k),
s AS (SELECT v.*, 1 / (1 + exp(-({odds}))) AS x, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM v, e WHERE k = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x >= {KEEP_FROM} AS kept, round(x, 6) AS posterior FROM s
"""


OP5_SQL = _oracle()
