"""Queries over whole reports, scans, libraries of cases, and single functions of the engine; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import approvals, evaluate, multisource, pipeline, report, skills, tool
from ..schemas import CLASSES, SOURCE, highest_class
from ..sources.readers import _fields, shuffled
from .oracles import POLICY, PREDICTED, VERDICTS, _pick
from .queries import _predictions, _requests, _verdicts, pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_D, _L = ("allow", "warn", "review", "block"), ("low", "medium", "high", "critical")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# Reports


def _runtime(spark, sf) -> DataFrame:
    return _verdicts(spark, sf).where("event_id % 3 > 0").withColumn("tool_guard_entered", F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 4 == 1))


def _scans(spark, sf) -> DataFrame:
    return _verdicts(spark, sf).where("event_id % 3 = 0").withColumn("related_event_id", F.when(F.col("event_id") % 5 > 0, F.when(F.col("event_id") % 2 == 0, F.col("id")).otherwise("")))


_RUN = "run AS (SELECT *, coalesce(event_id % 7 > 0 AND event_id % 4 = 1, false) AS entered FROM v WHERE event_id % 3 > 0)"
_SCAN = "scan AS (SELECT *, event_id % 5 > 0 AND event_id % 2 = 0 AS related FROM v WHERE event_id % 3 = 0)"
_STAGES = "SELECT count(*) AS total_events, count(*) FILTER (WHERE entered) AS tool_guard_entered_count, count(*) FILTER (WHERE NOT entered) AS tool_guard_skipped_count FROM run"
_RELATED = "SELECT count(*) AS total_scans, count(*) FILTER (WHERE related) AS related_to_runtime_count, count(*) FILTER (WHERE NOT related) AS independent_scan_count FROM scan"


@query(f"WITH {VERDICTS}, {_RUN} {_STAGES}")
def stage_counts(spark, sf):
    return report.stage_counts(_runtime(spark, sf))


@query(f"WITH {VERDICTS}, {_SCAN} {_RELATED}")
def related_counts(spark, sf):
    return report.related_counts(_scans(spark, sf))


def _unpivot(section: str, source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{c}' AS measure, '' AS value, {c}::BIGINT AS n FROM ({source})" for c in columns)


def _stats_sql(section: str, rows: str) -> str:
    parts = []
    for column, order in (("decision", _D), ("risk_level", _L)):
        parts.append(f"SELECT '{section}', '{column}_stats', d.value, count(r.{column}) FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in order)}) d(value) LEFT JOIN {rows} r ON r.{column} = d.value GROUP BY d.value")
        parts.append(f"SELECT '{section}', '{column}_stats', {column}, count(*) FROM {rows} WHERE {column} NOT IN {order} GROUP BY {column}")
    parts.append(f"SELECT '{section}', 'top_matched_rules', rule, count(*) FROM (SELECT unnest(rules) AS rule FROM {rows}) GROUP BY rule")
    return " UNION ALL ".join(parts)


def _modules_sql(section: str, rows: str) -> str:
    counts = {"n": "count(*)"} | {f"n_{d}": f"count(*) FILTER (WHERE decision = '{d}')" for d in _D} | {f"n_{x}": f"count(*) FILTER (WHERE risk_level = '{x}')" for x in _L}
    parts = [f"SELECT '{section}', 'module_{k}', module, {c} FROM {rows} GROUP BY module" for k, c in counts.items()]
    parts.append(f"SELECT '{section}', 'high_risk_records', '', count(*) FROM {rows} WHERE risk_level IN ('high', 'critical') OR decision IN ('review', 'block')")
    return " UNION ALL ".join(parts)


_BAD = "SELECT 'invalid_risk_level' AS issue FROM v WHERE risk_level NOT IN ('low', 'medium', 'high', 'critical')"
_SUMMARY = f"""WITH {VERDICTS}, {_RUN}, {_SCAN}, s AS (
{_unpivot('runtime', _STAGES, ('total_events', 'tool_guard_entered_count', 'tool_guard_skipped_count'))} UNION ALL {_unpivot('skill', _RELATED, ('total_scans', 'related_to_runtime_count', 'independent_scan_count'))}
UNION ALL SELECT 'overall', 'total_records', '', count(*) FROM v UNION ALL {_stats_sql('runtime', 'run')} UNION ALL {_stats_sql('skill', 'scan')} UNION ALL {_stats_sql('overall', 'v')}
UNION ALL {_modules_sql('runtime', 'run')} UNION ALL {_modules_sql('skill', 'scan')}
UNION ALL SELECT 'data_quality', 'issues', issue, count(*) FROM ({_BAD}) GROUP BY issue UNION ALL SELECT 'data_quality', 'issue_count', '', count(*) FROM ({_BAD}))"""


def _summary(spark, sf) -> DataFrame:
    known = _verdicts(spark, sf).withColumn("evidence", F.array(F.lit("x")))
    issues = report.quality_issues(known.select("id", "risk_score", "risk_level", "decision", "matched_rules", "evidence", "event_id"), "id", order=("event_id",))
    return report.summary(_runtime(spark, sf), _scans(spark, sf), issues)


@query(f"{_SUMMARY} SELECT section, measure, value, n FROM s")
def report_summary(spark, sf):
    return _summary(spark, sf)


def _map_sql(section: str, measure: str) -> str:
    return f"(SELECT array_to_string(list(value || '=' || n ORDER BY value), '|') FROM s WHERE section = '{section}' AND measure = '{measure}')"


def _one_sql(section: str, measure: str) -> str:
    return f"(SELECT n FROM s WHERE section = '{section}' AND measure = '{measure}')"


@query(f"""{_SUMMARY} SELECT {_one_sql('runtime', 'total_events')} AS runtime_total, {_one_sql('skill', 'total_scans')} AS skill_total, {_one_sql('runtime', 'high_risk_records')} + {_one_sql('skill', 'high_risk_records')} AS high_risk,
{_one_sql('data_quality', 'issue_count')} AS quality_issues, {_map_sql('runtime', 'decision_stats')} AS runtime_decision, {_map_sql('skill', 'risk_level_stats')} AS skill_risk_level,
(SELECT array_to_string(list(value ORDER BY n DESC, value), '|') FROM s WHERE section = 'overall' AND measure = 'top_matched_rules') AS top_rules""")
def display_stats(spark, sf):
    df = report.display_stats(_summary(spark, sf))
    shown = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "|")
    return df.select("runtime_total", "skill_total", "high_risk", "quality_issues", shown("runtime_decision").alias("runtime_decision"), shown("skill_risk_level").alias("skill_risk_level"), F.array_join("top_rules", "|").alias("top_rules"))


# Scans

_CALLS = (("print(1)", "", 0), ("eval(1)", "eval", 12), ("open('a.txt')", "open", 3), ("import os\nos.system('x')", "os.system", 8), ("open('.env')", "open_sensitive", 9), ("import os\nos.popen('x')\neval(2)\nexec(3)", "os.popen|eval|exec", 31))
_SCORE = "CASE WHEN w <= 0 THEN 0 WHEN w <= 4 THEN 30 WHEN w <= 9 THEN 65 WHEN w <= 14 THEN 85 ELSE 100 END"
_SCANNED = f"""k AS (SELECT event_id, ts, {_pick(tuple(c for _, c, _ in _CALLS), 'event_id % 6')} AS calls, CASE WHEN event_id % 17 = 0 THEN 0 ELSE [{', '.join(str(w) for *_, w in _CALLS)}][(event_id % 6 + 1)::INT] END AS w, event_id % 17 = 0 AS gone FROM events)"""


def _scanned(spark, sf) -> DataFrame:
    e = F.col("event_id")
    source = F.when(e % 17 > 0, pick(tuple(s for s, *_ in _CALLS), e % 6))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("scanned_at"), F.concat(F.lit("/skills/"), F.lpad(e.cast("string"), 12, "0"), F.lit(".py")).alias("file_path"), source.alias("source"), F.when(e % 2 == 0, e.cast("string")).alias("related_event_id"))
    return skills.scan_records(rows)


@query(f"""WITH {_SCANNED}, n AS (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS no FROM k)
SELECT 'SCAN-' || strftime(ts, '%Y%m%d') || '-' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 3, '0') ELSE no::VARCHAR END AS scan_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS related_event_id,
  lpad(event_id::VARCHAR, 12, '0') || '.py' AS skill_name, CASE WHEN gone THEN 'failed' ELSE 'completed' END AS scan_status, ({_SCORE})::BIGINT AS score,
  CASE WHEN w <= 0 THEN 'allow' WHEN w <= 4 THEN 'warn' WHEN w <= 9 THEN 'review' ELSE 'block' END AS decision, CASE WHEN gone THEN '' ELSE calls END AS rules FROM n""")
def scan_records(spark, sf):
    return _scanned(spark, sf).select("scan_id", "related_event_id", "skill_name", "scan_status", F.round(F.col("risk_score") * 100).cast("long").alias("score"), "decision", F.array_join("matched_rules", "|").alias("rules"))


@query(f"WITH {_SCANNED} SELECT count(*) AS total_files_scanned, count(*) FILTER (WHERE NOT gone) AS success_count, count(*) FILTER (WHERE gone) AS error_count, count(*) FILTER (WHERE NOT gone AND w > 4) AS high_risk_count, count(*) FILTER (WHERE NOT gone AND w > 9) AS critical_count FROM k")
def scan_summary(spark, sf):
    return report.scan_summary(_scanned(spark, sf))


# Libraries of cases


def _library(spark, sf) -> DataFrame:
    p, i = _predictions(spark, sf), F.col("doc_id")
    return p.select(i.cast("string").alias("case_id"), pick(_L, i % 4).alias("expected_level"), pick((*_L, None), i % 5).alias("risk_level"), pick(_D, i % 4).alias("expected_action"), pick(_D, F.floor(i / 2) % 4).alias("decision"), evaluate.outcome(F.col("expected"), F.col("predicted")).alias("outcome"))


_LIB = f"""{PREDICTED}, l AS (SELECT doc_id::VARCHAR AS case_id, {_pick(_L, 'doc_id % 4')} AS expected_level, {_pick((*_L, None), 'doc_id % 5')} AS risk_level, {_pick(_D, 'doc_id % 4')} AS expected_action, {_pick(_D, '(doc_id // 2) % 4')} AS decision,
  CASE WHEN expected THEN CASE WHEN predicted THEN 'TP' ELSE 'FN' END WHEN predicted THEN 'FP' ELSE 'TN' END AS outcome FROM p), m AS (SELECT *, coalesce(expected_level = risk_level, false) AS a, expected_action = decision AS b FROM l)"""


@query(f"""WITH {_LIB} SELECT 'total' AS measure, '' AS value, count(*) AS n FROM m UNION ALL SELECT 'level_correct', '', count(*) FILTER (WHERE a) FROM m UNION ALL SELECT 'action_correct', '', count(*) FILTER (WHERE b) FROM m
UNION ALL SELECT 'failed', '', count(*) FILTER (WHERE NOT (a AND b)) FROM m UNION ALL SELECT 'outcome', outcome, count(*) FROM m GROUP BY outcome""")
def library_summary(spark, sf):
    return evaluate.library_summary(_library(spark, sf))


@query(f"WITH {_LIB} SELECT case_id, expected_level, risk_level, expected_action, decision FROM m WHERE NOT (a AND b)")
def library_failures(spark, sf):
    return evaluate.library_failures(_library(spark, sf))


def _cases(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    held = table(spark, sf, "labels")
    s = lambda c: c.cast("string")
    cases = held.select(s(i).alias("case_id"), F.map_filter(F.create_map(F.lit("decision"), pick(_D, i % 4), F.lit("status"), F.when(i % 3 == 0, "executed")), lambda k, v: v.isNotNull()).alias("expected"))
    got = held.where("doc_id % 11 > 0").select(s(i).alias("case_id"), F.create_map(F.lit("decision"), pick(_D, F.when(i % 13 == 0, 0).otherwise(i % 4)), F.lit("status"), F.when(i % 2 == 0, "executed").otherwise("blocked")).alias("actual"))
    return evaluate.case_checks(cases, got)


_CASES = "c AS (SELECT doc_id, doc_id % 11 = 0 OR (doc_id % 13 = 0 AND doc_id % 4 > 0) AS bad_decision, doc_id % 3 = 0 AND (doc_id % 11 = 0 OR doc_id % 2 = 1) AS bad_status FROM labels)"


@query(f"WITH {_CASES} SELECT doc_id::VARCHAR AS case_id, NOT bad_decision AND NOT bad_status AS passed, coalesce(array_to_string(list_filter([CASE WHEN bad_decision THEN 'decision' END, CASE WHEN bad_status THEN 'status' END], lambda x: x IS NOT NULL), '|'), '') AS failed FROM c")
def case_checks(spark, sf):
    return _cases(spark, sf).select("case_id", "passed", F.array_join(F.array_sort("failed"), "|").alias("failed"))


@query(f"WITH {_CASES} SELECT count(*) AS case_count, count(*) FILTER (WHERE NOT bad_decision AND NOT bad_status) AS passed_count, count(*) FILTER (WHERE bad_decision OR bad_status) AS failed_count, count(*) FILTER (WHERE bad_decision OR bad_status) = 0 AS passed FROM c")
def suite_summary(spark, sf):
    return evaluate.suite_summary(_cases(spark, sf))


@query(f"{POLICY.replace('SELECT event_id, CASE WHEN role', 'z AS (SELECT event_id, CASE WHEN role', 1)}) SELECT z.event_id, CASE WHEN r.tool = 'mystery' THEN 'tool is no longer registered' WHEN decision = 'block' THEN 'policy now blocks the request' END AS refusal FROM z JOIN r USING (event_id)".replace("FROM k)\nz AS", "FROM k),\nz AS"))
def approval_recheck(spark, sf):
    return approvals.rechecked(_requests(spark, sf)).select("event_id", "refusal")


# Single functions


@query(f"WITH {VERDICTS} SELECT event_id::VARCHAR AS event_id, 'x' AS module, points AS score, CASE WHEN event_id % 4 = 0 THEN 'review' ELSE decision END AS decision, CASE WHEN len(rules) = 0 THEN 'no rule matched' ELSE array_to_string(rules, '; ') END AS reason FROM v")
def unified_rows(spark, sf):
    v = _verdicts(spark, sf).select("event_id", (F.col("event_id") % 101).alias("score"), F.when(F.col("event_id") % 4 > 0, F.col("decision")).otherwise(" ").alias("decision"), F.lit("review").alias("actual_action"), "matched_rules")
    held = pipeline.validated(pipeline.unified(v, "x"))
    return held.select("event_id", "module", F.round(F.col("risk_score") * 100).cast("long").alias("score"), "decision", "reason")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN 'warn' ELSE 'review' END AS decision, CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN event_id % 150 <= 1 THEN (event_id % 150)::DOUBLE WHEN event_id % 150 <= 100 THEN round((event_id % 150) / 100.0, 4)::DOUBLE END AS risk_score FROM events")
def shown_rows(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", pick((" PASS", "denied?", "warning", "Review"), e % 4).alias("decision"), pick(("critial", "Mid", "low "), e % 3).alias("risk_level"), (e % 150).cast("double").alias("risk_score"))
    rows = rows.withColumn("decision", F.when(e % 4 == 1, "deny").otherwise(F.col("decision")))
    return report.shown(rows)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'shell' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'http_post' ELSE 'http_get' END WHEN 2 THEN 'file_read' WHEN 3 THEN 'shell' ELSE 'other' END AS tool FROM events")
def tool_alias(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", tool.alias(pick(("Shell_Exec", "http_request", " file_read ", "BASH", "other"), e % 5), pick(("post", "get"), e % 2)).alias("tool"))


@query("SELECT event_id, 'tool_name: ' || event_type || chr(10) || 'operation: read' || chr(10) || 'target: ' || chr(10) || 'arguments: ' || coalesce(props, '') AS lines FROM events")
def invocation_lines(spark, sf):
    return table(spark, sf, "events").select("event_id", tool.invocation(F.col("event_type"), F.lit("read"), F.lit(None).cast("string"), F.col("props")).alias("lines"))


@query("""SELECT event_id, '{"a":{"list":[1,"password=[REDACTED]"],"token":"[REDACTED]"},"b":' || event_id || '}' AS masked FROM events""")
def masked_json(spark, sf):
    text = F.concat(F.lit('{"b": '), F.col("event_id").cast("string"), F.lit(', "a": {"token": "'), F.col("event_id").cast("string"), F.lit('", "list": [1, "password=x"]}}'))
    return table(spark, sf, "events").select("event_id", T.redacted_json(text).alias("masked"))


def _envelopes(spark, sf) -> DataFrame:
    e = F.col("event_id")
    kinds = ("Webpage", "user", "mail", None)
    src = lambda k: F.struct(F.lit(None).cast("string").alias("source_id"), pick(kinds, (e + k) % 4).alias("source_type"), F.lit(None).cast("string").alias("trust_level"), pick((*CLASSES, None), (e + k) % 5).alias("classification"), F.lit(None).cast("string").alias("origin"), F.concat(F.lit("text "), (e + k).cast("string")).alias("content"))
    rows = table(spark, sf, "events").select("event_id", F.when(e % 7 > 0, F.slice(F.array(src(0), src(1), src(2)), 1, (e % 3 + 1).cast("int"))).cast(f"array<struct<{_fields(SOURCE)}>>").alias("sources"))
    return multisource.checked_sources(rows)


_KIND, _CLS = "['web', 'user', 'email', 'unknown'][((event_id + k) % 4 + 1)::INT]", "['public', 'internal', 'sensitive', 'secret', 'public'][((event_id + k) % 5 + 1)::INT]"
_ENV = f"s AS (SELECT event_id, k, 'text ' || (event_id + k) AS content, {_KIND} AS kind, {_CLS} AS cls, list_position(['public', 'internal', 'sensitive', 'secret'], {_CLS}) AS r FROM events, range(3) q(k) WHERE event_id % 7 > 0 AND k < event_id % 3 + 1)"


@query(f"WITH {_ENV}, g AS (SELECT event_id, array_to_string(list('SRC-' || lpad((k + 1)::VARCHAR, 3, '0') || ':' || kind || ':unknown' ORDER BY k), '|') AS sources, max(r) AS r FROM s GROUP BY event_id) SELECT e.event_id, coalesce(sources, '') AS sources, ['public', 'internal', 'sensitive', 'secret'][coalesce(r, 1)] AS highest FROM events e LEFT JOIN g USING (event_id)")
def envelope_sources(spark, sf):
    df = _envelopes(spark, sf)
    named = F.array_join(F.transform("sources", lambda s: F.concat(s["source_id"], F.lit(":"), s["source_type"], F.lit(":"), s["trust_level"])), "|")
    return df.select("event_id", named.alias("sources"), highest_class(F.transform("sources", lambda s: s["classification"])).alias("highest"))


_ROW = """'{"content_bytes":' || strlen(content) || ',"content_sha256":"' || sha256(content) || '","classification":"' || cls || '","origin":"","source_id":"SRC-' || lpad((k + 1)::VARCHAR, 3, '0') || '","source_type":"' || kind || '","trust_level":"unknown"}'"""


@query(f"WITH {_ENV}, g AS (SELECT event_id, array_to_string(list({_ROW} ORDER BY k), ',') AS t FROM s GROUP BY event_id) SELECT e.event_id, sha256('[' || coalesce(t, '') || ']') AS digest FROM events e LEFT JOIN g USING (event_id)")
def manifest_digests(spark, sf):
    return _envelopes(spark, sf).select("event_id", multisource.manifest_digest(F.col("sources")).alias("digest"))


@query("SELECT event_id, row_number() OVER (ORDER BY md5('20260828-' || event_id), event_id) AS place FROM events")
def shuffled_rows(spark, sf):
    return shuffled(table(spark, sf, "events").select("event_id"), "event_id", 20260828)
