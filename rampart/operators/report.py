"""Reports over stored verdicts: counts, rule frequencies, high-risk rows, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DECISIONS, LEVELS

#: Forms of ids.
EVENT_ID, SCAN_ID = "^EVT-(\\d{8})-\\d{3,}$", "^SCAN-(\\d{8})-\\d{3,}$"
REQUIRED = ("event_id", "module", "risk_score", "risk_level", "decision", "reason", "matched_rules", "evidence", "timestamp")


def counted(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """value and n: a row for each value of the order, 0 where none is met, then any others by name."""
    dim = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(order)], "at int, value string")
    got = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    joined = got.join(dim, "value", "full")
    return joined.select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("at", F.lit(len(order))).alias("position"))


def rule_frequency(rows: DataFrame, top: int | None = 20) -> DataFrame:
    """rule_id and n, most frequent first, ties by name."""
    got = rows.select(F.explode("matched_rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return got if top is None else got.orderBy(F.desc("n"), "rule_id").limit(top)


def on_date(rows: DataFrame, id_column: str, date: str | None, form: str = EVENT_ID) -> DataFrame:
    """Rows whose id names the date (yyyyMMdd); ids of another form fall out once a date is given."""
    return rows if date is None else rows.where(F.regexp_extract(F.coalesce(id_column, F.lit("")), form, 1) == date)


def high_risk(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("risk_level").isin("high", "critical") | F.col("decision").isin("review", "block"))


def module_stats(rows: DataFrame) -> DataFrame:
    """Counts by module, decision and level, in one pass."""
    return rows.groupBy("module").agg(F.count("*").alias("n"), *(F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in DECISIONS), *(F.count_if(F.col("risk_level") == x).alias(f"n_{x}") for x in LEVELS))


def overall(runtime: DataFrame, scans: DataFrame) -> DataFrame:
    """Decision counts of both scopes together."""
    both = runtime.select("decision").unionByName(scans.select("decision"))
    return both.groupBy("decision").agg(F.count("*").alias("n"))


def rule_rows(runtime: DataFrame, scans: DataFrame) -> DataFrame:
    """scope, rule_id and n of both scopes."""
    return rule_frequency(runtime, None).withColumn("scope", F.lit("runtime")).unionByName(rule_frequency(scans, None).withColumn("scope", F.lit("skill_scan")))


def missing_related(scans: DataFrame, runtime: DataFrame) -> DataFrame:
    """Scans that name an event which isn't there."""
    named = scans.where(F.coalesce("related_event_id", F.lit("")) != "")
    return named.join(runtime.select(F.col("event_id").alias("related_event_id")), "related_event_id", "left_anti")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def quality_issues(rows: DataFrame, id_column: str = "event_id", form: str = EVENT_ID, order: tuple[str, ...] = ("file",), kind: str = "event") -> DataFrame:
    """id, file and issue: a row for each defect of each record. Records with defects stay in the counts.

    rows: the verdict's fields, `file`, and where they are there `nested_event_id`, `tool_guard_entered`, `has_tool_result`.
    """
    c = F.col
    have = set(rows.columns)
    fields = [f for f in REQUIRED if f in have]
    # Only ids that occur twice meet their rows again; the first of them is a minimum, which combines on the map side.
    firsts = rows.where(~_blank(c(id_column))).groupBy(c(id_column).alias("_id")).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_id", "_first")
    rows = rows.join(firsts, c(id_column) == c("_id"), "left")
    checks = [
        (F.greatest(*(c(f).isNull() for f in fields), F.lit(False)), "missing_fields"),
        (~F.coalesce(c("risk_score").between(0, 1), F.lit(False)), "invalid_risk_score"),
        (~F.coalesce(c("risk_level").isin(*LEVELS), F.lit(False)), "invalid_risk_level"),
        (~F.coalesce(c("decision").isin(*DECISIONS), F.lit(False)), "invalid_decision"),
        (c("matched_rules").isNull(), "invalid_matched_rules"),
        (c("evidence").isNull(), "invalid_evidence"),
        (~F.coalesce(c(id_column).rlike(form), F.lit(False)), f"invalid_{kind}_id"),
        (c("_first").isNotNull() & (F.struct(*order) != c("_first")), f"duplicate_{kind}_id"),
    ]
    if "file" in have:
        checks.append((F.regexp_extract(c("file"), "([^/]+?)(\\.json)?$", 1) != F.coalesce(c(id_column), F.lit("")), "filename_id_mismatch"))
    if "nested_event_id" in have:
        checks.append((c("nested_event_id").isNotNull() & (c("nested_event_id") != c(id_column)), "event_id_mismatch"))
    if {"tool_guard_entered", "has_tool_result"} <= have:
        checks.append((c("tool_guard_entered") != c("has_tool_result"), "tool_stage_inconsistent"))
    listed = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))
    held = rows.withColumn("_issues", listed)
    return held.select(c(id_column).alias("id"), *([c("file")] if "file" in have else []), F.explode("_issues").alias("issue"))


def flattened(rows: DataFrame) -> DataFrame:
    """Lists as text joined by ` | `, nulls as empty text, for CSV."""
    out = [F.array_join(F.col(f.name).cast("array<string>"), " | ").alias(f.name) if f.dataType.typeName() == "array" else F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map") else F.col(f.name).cast("string").alias(f.name) for f in rows.schema.fields]
    return rows.select(*out).fillna("")


def shown(rows: DataFrame) -> DataFrame:
    """For display: other names of decisions and levels, scores of 1 to 100 as shares, bad ones as null."""
    d, x, s = F.lower(F.trim("decision")), F.lower(F.trim("risk_level")), F.col("risk_score").cast("double")
    decision = F.when(d.isin("pass", "passed", "allowed"), "allow").when(d.isin("blocked", "deny"), "block").when(d == "warning", "warn").otherwise(d)
    level = F.when(x.isin("critial", "severe"), "critical").when(x == "mid", "medium").otherwise(x)
    score = F.when((s >= 0) & (s <= 1), s).when((s > 1) & (s <= 100), s / 100)
    return rows.withColumn("decision", decision).withColumn("risk_level", level).withColumn("risk_score", F.round(score, 4))


def control_summary(approvals: DataFrame, chains: DataFrame, audits: DataFrame) -> DataFrame:
    """section, value and n: approvals by status, chain decisions, chain rules, audit stages."""
    one = lambda df, c, s: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), "value", "n")
    rules = chains.select(F.explode("chain_rules").alias("rule"))
    return one(approvals, "status", "approvals").unionByName(one(chains, "chain_decision", "chain_decisions")).unionByName(one(rules, "rule", "chain_rules")).unionByName(one(audits, "stage", "audit_stages"))


def stage_counts(runtime: DataFrame) -> DataFrame:
    """Events, and how many of them entered the tool stage or skipped it."""
    entered = F.coalesce("tool_guard_entered", F.lit(False))
    return runtime.agg(F.count("*").alias("total_events"), F.count_if(entered).alias("tool_guard_entered_count"), F.count_if(~entered).alias("tool_guard_skipped_count"))


def related_counts(scans: DataFrame) -> DataFrame:
    """Scans, and how many of them name an event or stand alone."""
    related = F.coalesce("related_event_id", F.lit("")) != ""
    return scans.agg(F.count("*").alias("total_scans"), F.count_if(related).alias("related_to_runtime_count"), F.count_if(~related).alias("independent_scan_count"))


def _stats(rows: DataFrame, section: str) -> DataFrame:
    """Decisions and levels, in order and with zeros, then any others."""
    parts = [counted(rows.where(F.coalesce(c, F.lit("")) != ""), c, order).select(F.lit(section).alias("section"), F.lit(f"{c}_stats").alias("measure"), "value", "n") for c, order in (("decision", DECISIONS), ("risk_level", LEVELS))]
    return parts[0].unionByName(parts[1])


def _wide(df: DataFrame, section: str) -> DataFrame:
    """The columns of a row of counts as rows."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(section).alias("section"), F.lit(c).alias("measure"), F.lit("").alias("value"), F.col(c).cast("long").alias("n")) for c in df.columns))).alias("x")).select("x.*")


def _top(rows: DataFrame, section: str, top: int) -> DataFrame:
    return rule_frequency(rows, top).select(F.lit(section).alias("section"), F.lit("top_matched_rules").alias("measure"), F.col("rule_id").alias("value"), "n")


def _modules(rows: DataFrame, section: str) -> DataFrame:
    stats = module_stats(rows)
    counts = [c for c in stats.columns if c != "module"]
    return stats.select(F.lit(section).alias("section"), F.explode(F.array(*(F.struct(F.lit(f"module_{c}").alias("measure"), F.col("module").alias("value"), F.col(c).alias("n")) for c in counts))).alias("x")).select("section", "x.*")


def summary(runtime: DataFrame, scans: DataFrame, issues: DataFrame, top: int = 20) -> DataFrame:
    """section, measure, value and n: the whole report of runtime verdicts, scans and data-quality issues.

    runtime: module, decision, risk_level, matched_rules, tool_guard_entered. scans: related_event_id in place of the last. high_risk() has the records themselves.
    """
    shared = ["module", "decision", "risk_level", "matched_rules"]
    both = runtime.select(*shared).unionByName(scans.select(*shared))
    parts = [_wide(stage_counts(runtime), "runtime"), _wide(related_counts(scans), "skill"), _wide(both.agg(F.count("*").alias("total_records")), "overall")]
    for rows, section in ((runtime, "runtime"), (scans, "skill"), (both, "overall")):
        parts += [_stats(rows, section), _top(rows, section, top)]
        if section != "overall":
            parts += [_modules(rows, section), _wide(high_risk(rows).agg(F.count("*").alias("high_risk_records")), section)]
    parts.append(issues.groupBy(F.col("issue").alias("value")).agg(F.count("*").alias("n")).select(F.lit("data_quality").alias("section"), F.lit("issues").alias("measure"), "value", "n"))
    parts.append(_wide(issues.agg(F.count("*").alias("issue_count")), "data_quality"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def display_stats(report: DataFrame) -> DataFrame:
    """What a display shows of a summary(): one row of totals, maps of decisions and levels, top rules, high-risk records and issues."""
    c = F.col
    one = lambda section, measure: F.coalesce(F.max(F.when((c("section") == section) & (c("measure") == measure), c("n"))), F.lit(0))
    named = lambda section, measure: F.map_from_entries(F.array_sort(F.collect_list(F.when((c("section") == section) & (c("measure") == measure), F.struct("value", "n")))))
    top = F.array_sort(F.collect_list(F.when((c("section") == "overall") & (c("measure") == "top_matched_rules"), F.struct((-c("n")).alias("order"), c("value").alias("rule_id")))))
    high = one("runtime", "high_risk_records") + one("skill", "high_risk_records")
    return report.agg(
        one("runtime", "total_events").alias("runtime_total"), one("skill", "total_scans").alias("skill_total"), high.alias("high_risk"), one("data_quality", "issue_count").alias("quality_issues"),
        *(named(s, f"{m}_stats").alias(f"{s}_{m}") for s in ("runtime", "skill") for m in ("decision", "risk_level")), F.transform(top, lambda x: x["rule_id"]).alias("top_rules"),
    )


def scan_summary(scans: DataFrame) -> DataFrame:
    """Of scans (decision fields, error): files, successes, errors, and those of high or critical risk."""
    failed = F.col("error").isNotNull()
    level = F.when(~failed, F.col("risk_level"))
    return scans.agg(F.count("*").alias("total_files_scanned"), F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("error_count"), F.count_if(level.isin("high", "critical")).alias("high_risk_count"), F.count_if(level == "critical").alias("critical_count"))
