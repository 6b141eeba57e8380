"""Jobs for spark-submit: `report` of stored verdicts, `prompts` and `tools` from JSON lines, `skills` of a folder, `packages` of archives, one `call`, and `stream`, which judges requests as they come."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import packages, report, skills
from .operators.pipeline import unified
from .operators.policy import Policy
from .operators.prompt import prompt_verdicts
from .operators.tool import tool_verdicts
from .rules import PROMPT_RULES, TOOL_RULES, merged, read_pack
from .sources import readers, sinks
from .streaming import requests


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rampart", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("report")
    job.add_argument("--runtime", required=True)
    job.add_argument("--scans", required=True)
    job.add_argument("--date", help="yyyyMMdd: only records whose id names that day")
    for name in ("prompts", "tools"):
        job = jobs.add_parser(name)
        job.add_argument("--input", required=True)
        job.add_argument("--rules")
    for name in ("skills", "packages"):
        jobs.add_parser(name).add_argument("--input", required=True)
    job = jobs.add_parser("call")
    job.add_argument("--tool", required=True)
    job.add_argument("--operation", default="read")
    job.add_argument("--target", default="")
    job.add_argument("--arguments", default="{}", help="a JSON object")
    job = jobs.add_parser("stream")
    job.add_argument("--input", required=True, help="a folder that JSON lines of requests come to")
    job.add_argument("--checkpoint", required=True)
    job.add_argument("--every", help="as 10 seconds; without it, what is there is judged and the job ends")
    for j in jobs.choices.values():
        j.add_argument("--output", required=True)
    return top


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    runtime, broken = readers.records(spark, a.runtime)
    scans, broken_scans = readers.scans(spark, a.scans)
    runtime, scans = report.on_date(runtime, "event_id", a.date), report.on_date(scans, "scan_id", a.date, report.SCAN_ID)
    issues = report.quality_issues(runtime).select("file", "issue").unionByName(report.quality_issues(scans, "scan_id", report.SCAN_ID, kind="scan").select("file", "issue")).unionByName(broken).unionByName(broken_scans)
    missing = report.missing_related(scans, runtime).select("file", F.lit("missing_related_event").alias("issue"))
    issues = issues.unionByName(missing)
    if "tool_guard_entered" not in runtime.columns:
        runtime = runtime.withColumn("tool_guard_entered", F.lit(None).cast("boolean"))
    parts = {"summary": report.summary(runtime, scans, issues), "issues": issues, "rules": report.rule_rows(runtime, scans), "high_risk_runtime": report.high_risk(runtime), "high_risk_scans": report.high_risk(scans)}
    sinks.bundle(parts, a.output)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    if a.job == "call" and not isinstance(json.loads(a.arguments), dict):
        raise SystemExit("--arguments must be a JSON object")
    spark = spark or SparkSession.builder.appName("rampart").getOrCreate()
    if a.job == "report":
        _report(spark, a)
    elif a.job == "prompts":
        rules = merged(PROMPT_RULES, read_pack(spark, a.rules)) if a.rules else PROMPT_RULES
        rows = readers.json_lines(spark, a.input, "event_id string, input_text string, input_source string")
        sinks.write_json(unified(prompt_verdicts(rows, "input_text", "input_source", rules), "input_guard"), a.output)
    elif a.job in ("tools", "call"):
        rules = read_pack(spark, a.rules) if a.job == "tools" and a.rules else TOOL_RULES
        columns = "event_id string, tool_name string, operation string, target string, arguments string"
        rows = readers.json_lines(spark, a.input, columns) if a.job == "tools" else spark.createDataFrame([("call", a.tool, a.operation, a.target, json.dumps(json.loads(a.arguments), sort_keys=True))], columns)
        sinks.write_json(unified(tool_verdicts(rows, rules), "tool_guard", structured=True), a.output)
    elif a.job == "skills":
        rows = readers.python_tree(spark, a.input).select(F.col("path").alias("file_path"), "source", F.current_timestamp().alias("scanned_at"), F.lit(None).cast("string").alias("related_event_id"))
        sinks.write_json(skills.scan_records(rows), a.output)
    elif a.job == "stream":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        rows = spark.readStream.schema(requests.REQUEST).json(a.input)
        trigger = {"processingTime": a.every} if a.every else {"availableNow": True}
        requests.start(rows, a.output, tuple(Policy().tool_risk), a.checkpoint, **trigger).awaitTermination()
    else:
        sinks.write_json(packages.package_verdicts(packages.archive_files(readers.archives(spark, a.input))), a.output)


if __name__ == "__main__":
    main()
