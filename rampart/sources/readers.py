"""Sources: JSON lines, case libraries, record folders, audit logs, CSV, sheets, text, file trees and archives."""

from __future__ import annotations

from functools import reduce

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import AUDIT, SCAN, VERDICT

_BAD = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def cases(spark: SparkSession, path: str, schema: str, key: str = "case_id", least: int = 1, required: tuple[str, ...] = (), kinds: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The objects of a JSON document {"cases": [...]}. Too few, lacking keys, repeated ids or, with `kinds` (a column and its values), other values raise."""
    df = spark.read.schema(f"cases array<struct<{_fields(schema)}>>").json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    need = (key, *required)
    found = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), *(F.count_if(F.col(k).isNull()).alias(f"no_{k}") for k in need)).first()
    if found["n"] < least:
        raise ValueError(f"{found['n']} cases; at least {least} are needed")
    if lacking := [k for k in need if found[f"no_{k}"]]:
        raise ValueError(f"cases lack {', '.join(lacking)}")
    if found["ids"] != found["n"]:
        raise ValueError(f"repeated {key}")
    if kinds and (odd := df.where(~F.col(kinds[0]).isin(*kinds[1])).limit(1).collect()):
        raise ValueError(f"unknown {kinds[0]} {odd[0][kinds[0]]!r}")
    return df


def _fields(ddl: str) -> str:
    """`a string, b long` as the inside of a struct type."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += c in "<(" and 1 or c in ">)" and -1 or 0
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def records(spark: SparkSession, folder: str, schema: str = VERDICT, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """JSON documents of a folder and those below it, and the issues of those that can't be read. Rows carry `file`, the path below the folder."""
    below = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(folder.rstrip("/").rpartition("/")[2]) + "/", "")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True).select("value", below.alias("file"))
    df = raw.select("file", F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("_r")).select("file", "_r.*")
    broken = df.where(F.col(_BAD).isNotNull()).select("file", F.lit("json_read_error").alias("issue"))
    return df.where(F.col(_BAD).isNull()).drop(_BAD), broken


def lenient_records(spark: SparkSession, folder: str, schema: str = VERDICT, pattern: str = "*.json") -> DataFrame:
    """As records(), with unreadable documents left out in silence."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(folder, multiLine=True, mode="DROPMALFORMED")


def approvals(spark: SparkSession, folder: str, status: str | None = None, pattern: str = "*.json") -> DataFrame:
    """Approval records of a folder, of one status or all, newest first; unreadable documents are left out."""
    held = lenient_records(spark, folder, "approval_id string, event_id string, status string, created_at string, requested_by string, decided_by string", pattern)
    held = held.where("approval_id IS NOT NULL")
    return (held if status is None else held.where(F.col("status") == status)).orderBy(F.desc("created_at"), "approval_id")


def report_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of report.summary() that a bundle has in its folder."""
    return spark.read.schema("section string, measure string, value string, n long").json(f"{folder}/summary_json")


def scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return records(spark, folder, SCAN)


def audit_log(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Entries of an audit log of JSON lines. A line that isn't an entry raises. more: columns beside an entry's, as of partitions."""
    return spark.read.schema(f"{AUDIT}, {more}" if more else AUDIT).json(path, mode="FAILFAST")


#: Where a line lies: its file, the start of the block that it was read in, and a number that grows within the block.
_LINE = "_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS at"


def numbered_lines(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """file, line (from 1) and value of the lines of text files that meet a condition on `value`.

    Files of any size are read in blocks side by side. Lines are counted by block, a row each; the counts before a block
    in its file, and a line's place in its block, make its number. Only wanted lines are moved.
    """
    lines = spark.read.text(path).selectExpr("value", *_LINE)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    met = lines.where(wanted).join(ahead, ["file", "block"])
    return met.select("file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def broken_lines(spark: SparkSession, path: str, schema: str = AUDIT, required: tuple[str, ...] = ("sequence", "entry_hash")) -> DataFrame:
    """file, line and value of lines that aren't a JSON object of a schema with the required fields. Blank lines are skipped."""
    read = F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    wrong = read[_BAD].isNotNull()
    for field in required:
        wrong = wrong | read[field].isNull()
    return numbered_lines(spark, path, (F.trim("value") != "") & F.coalesce(wrong, F.lit(True)))


def strict_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """As audit_log(), but what raises names the file and line of the first broken one."""
    first = broken_lines(spark, path).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}, line {first[0]['line']}: not an audit entry")
    return spark.read.schema(AUDIT).json(path)


def csv_ids(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True).select(key)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """value and file: whole texts."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))


def file_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length and content of the files below root. Links aren't followed by Spark's listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def python_tree(spark: SparkSession, root: str, most: int = 2 << 20, allowed: tuple[str, ...] = (), pattern: str = "*.py") -> DataFrame:
    """path, source and finding of Python files. A file over a size has no source and a finding. allowed: roots of which it must lie in one."""
    if allowed and not any(root == a or root.startswith(a.rstrip("/") + "/") for a in allowed):
        raise ValueError(f"{root} is outside the allowed roots")
    fine = F.col("length") <= most
    source = F.make_valid_utf8(F.col("content").cast("string"))
    return file_tree(spark, root, pattern).select("path", F.when(fine, source).alias("source"), F.when(~fine, "source_too_large").alias("finding"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    return file_tree(spark, path, "*.zip")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of an xlsx file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [None] * (at - len(cells))
                v, t = c.find("m:v", _NS), c.find("m:is/m:t", _NS)
                cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" and v is not None else (t.text if t is not None else v.text if v is not None else None)
            rows.append(cells)
        return rows


def sheet_library(spark: SparkSession, path: str, header_row: int = 2) -> DataFrame:
    """file, row and cells (by header) of xlsx files. Rows with an empty first cell are left out."""

    def run(frames):
        for pdf in frames:
            out = []
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = _sheet(bytes(data))
                head = rows[header_row - 1] if len(rows) >= header_row else []
                out += [(file, k, {h: v for h, v in zip(head, r, strict=False) if h}) for k, r in enumerate(rows[header_row:], header_row + 1) if r and r[0]]
            yield pd.DataFrame(out, columns=["file", "row", "cells"])

    return file_tree(spark, path, "*.xlsx").select("path", "content").mapInPandas(run, "file string, row int, cells map<string,string>")


def shuffled(rows: DataFrame, key: str, seed: int, place: str = "place") -> DataFrame:
    """rows with their place from 1 in an order that the seed shuffles, the same in every run. Rows are counted by parts of the order first and numbered within them, so none is gathered."""
    turn = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    df = rows.withColumn("_turn", turn).withColumn("_part", F.substring("_turn", 1, 2))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over 256 rows at most
    ahead = df.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    n = F.row_number().over(Window.partitionBy("_part").orderBy("_turn", key)) + F.col("_ahead")
    return df.join(F.broadcast(ahead), "_part").withColumn(place, n).drop("_turn", "_part", "_ahead")


#: Ways in which a benchmark varies a text.
VARIANTS = ("plain", "polite", "context_noise", "line_break", "spaced", "url_encoded", "base64", "wrapped")


#: What a form encoder writes otherwise than percent encoding of all but unreserved characters.
URL_FORMS = (("+", "%20"), ("*", "%2A"), ("%7E", "~"))


def prompt_variants(bases: DataFrame) -> DataFrame:
    """bases (parent_id, place, label, category, text) by each variant, split by place among their label."""
    t = F.col("text")
    forms = {
        "plain": t, "polite": F.concat(F.lit("Please, if possible: "), t), "context_noise": F.concat(F.lit("Background: the weekly report is due. "), t, F.lit(" Thank you.")), "line_break": F.replace(t, F.lit(" "), F.lit("\n")),
        "spaced": F.array_join(F.split(t, " "), "  "), "url_encoded": reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), URL_FORMS, F.url_encode(t)), "base64": F.concat(F.lit("Decode this: "), F.replace(F.replace(F.base64(t.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))), "wrapped": F.concat(F.lit("[request] "), t, F.lit(" [/request]")),
    }
    split = F.when(F.col("place") < 8, "development").when(F.col("place") < 14, "validation").otherwise("holdout")
    rows = bases.select("parent_id", split.alias("split"), "label", "category", F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in forms.items())))).alias("variant", "input_text"))
    return rows.select(F.concat("parent_id", F.lit("-"), "variant").alias("sample_id"), "*")
