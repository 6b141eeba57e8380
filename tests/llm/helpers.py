"""Small document tables with the cases that every operator must bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((seed * 31 + i) % 13) for i in range(n))


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(r + (None,) * 5)[:5] for r in rows], DOCS)


def odd_docs(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    long = prose(5, 30_000)
    rows = [
        (1, prose(1, 80), "en", "a", 5), (2, None, "en", "a", None), (3, "", "de", None, 0), (4, " \n\t ", None, "a", 4), (5, prose(2, 60), None, None, 1),
        (None, prose(3, 60), "en", "b", 1), (None, None, None, None, None), (6, long, "en", "a", 1), (7, prose(1, 80), "en", "a", 5), (7, prose(1, 80), "en", "a", 5), (8, "one two", "fr", "b", 7), (9, "12 34 \U0001f600", "fr", "", 7),
    ]
    clash = ("_host", "kept", "score", "component_id", "_kept", "_drop", "row", "n_lines", "_source", "rep", "t1", "spans", "_text", "media", "sequence_id")
    return table(spark, rows).withColumns({c: F.lit("mine") for c in clash})


def none(spark: SparkSession) -> DataFrame:
    return table(spark, []).where("false")
