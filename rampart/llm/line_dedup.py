"""Line dedup by site-relative frequency. DataFrame functions only.

A line is boilerplate of a host if the pages of the host that hold it are more
than `max_percent` of all its pages, and at least `min_pages`. Such lines go
from every page of that host. Lines are split at newlines and compared without
white space at their ends; blank lines are neither counted nor dropped. A page
counts once however often it repeats a line.

A host has at most `lines a page * 100 / max_percent` boilerplate lines, so the
set that is attached to its pages is bounded. The counts are combined on the map
side, so a hot host or line costs one row a task. The sets are broadcast if a count
allows; beyond that each goes to SALTS parts of its host's pages, so that a hot host
is spread. A page's lines are looked up all at once. Lines are counted under their
64-bit hash.

Defined cases: a null text stays null and its page counts towards its host; a
null host and an empty one are the same host; a text that loses every line is
empty; repeated rows are pages of their own; an empty table gives an empty one;
other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

MAX_PERCENT = 10
MIN_PAGES = 3
#: Hosts' line sets are broadcast up to so many hashes (8 MB); beyond that the join shuffles, with each host in so many parts.
BROADCAST_HASHES = 1_000_000
SALTS = 64
_ENDS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_ENDS)))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_ENDS)) == ""


def boilerplate(pages: DataFrame, host: str, text: str = "text", max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host and _drop: the hashes of each host's boilerplate lines."""
    at = F.coalesce(F.col(host), F.lit("")).alias("_host")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _key))
    counts = pages.select(at, F.explode(keys).alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    totals = pages.select(at).groupBy("_host").agg(F.count("*").alias("_all"))
    kept = counts.join(totals, "_host").where(F.col("_pages") * 100 > F.col("_all") * max_percent)
    return kept.groupBy("_host").agg(F.collect_set("_key").alias("_drop"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """row (the other columns of pages, as a struct, so that no name clashes), text less its boilerplate lines, n_lines and n_dropped."""
    drop = materialise(boilerplate(pages, host, text, max_percent, min_pages), "boilerplate")
    hashes = drop.agg(F.sum(F.size("_drop"))).first()[0] or 0
    others = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != text)).alias("row")
    rows = pages.select(others, F.col(text).alias("text"), F.coalesce(F.col(host), F.lit("")).alias("_host"))
    if hashes <= BROADCAST_HASHES:
        joined = rows.join(F.broadcast(drop), "_host", "left")
    else:
        parts = drop.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(parts, ["_host", "_salt"], "left")
    lines = _lines(F.col("text"))
    # Those of the page's lines that go; few, so the filter's search is short.
    met = F.array_intersect(F.transform(lines, _key), F.col("_drop"))
    joined = joined.withColumn("_met", F.when(F.col("_drop").isNotNull(), met))
    kept = F.when(F.coalesce(F.size("_met"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("_met"), _key(x))))
    split = joined.select("row", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), kept.alias("_kept"))
    split = split.withColumn("n_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    return split.select("row", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"), "n_lines", "n_dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("row.doc_id", "row.source", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """documents in, documents out: the text without boilerplate lines and n_chars to match."""
    found = dedup_lines(docs)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS host, text FROM documents),
l AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS ord FROM d
),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM l),
c AS (SELECT host, k, count(DISTINCT doc_id) AS pages FROM t WHERE k <> '' GROUP BY host, k),
h AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT c.host, c.k FROM c JOIN h USING (host) WHERE pages >= {MIN_PAGES} AND pages * 100 > total * {MAX_PERCENT}),
m AS (SELECT t.*, b.k IS NOT NULL AS dropped FROM t LEFT JOIN b ON t.host = b.host AND t.k = b.k),
r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT dropped), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, d.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       coalesce(length(kept), 0)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
