"""Verdicts of all stages merged into one, with what each stage did and the final status of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DECISIONS, LEVELS, level_of, rank, strictest


def passes(decision: Column) -> Column:
    """Whether a stage lets the next one run."""
    return decision.isin("allow", "warn")


def gated(df: DataFrame) -> DataFrame:
    """df (prompt_decision, source_decision, skill_decision, tool_decision; null where a stage wasn't asked for) with
    input_gate_passed, skill_gate_passed, stage statuses and detection_decision.

    A stage after a failed gate is skipped and counts for nothing, whatever its column holds.
    """
    p, s, k, t = (F.col(f"{x}_decision") for x in ("prompt", "source", "skill", "tool"))
    gate = passes(p) & F.coalesce(passes(s), F.lit(True))
    skill = gate & F.coalesce(passes(k), F.lit(True))
    df = df.withColumn("input_gate_passed", gate).withColumn("skill_gate_passed", skill)
    df = df.withColumn("source_status", F.when(s.isNull(), "skipped_by_single_input").otherwise("completed"))
    df = df.withColumn("skill_status", F.when(~gate, "skipped_by_input_gate").when(k.isNull(), "not_requested").otherwise("completed"))
    df = df.withColumn("tool_status", F.when(~gate, "skipped_by_input_gate").when(~skill, "skipped_by_skill_gate").when(t.isNull(), "not_requested").otherwise("completed"))
    return df.withColumn("detection_decision", strictest(p, s, F.when(gate, k), F.when(skill, t), empty="block"))


def runtime_status(df: DataFrame, registered: tuple[str, ...]) -> DataFrame:
    """gated() rows with policy_decision, chain_decision, tool_name and execute, with final_decision, status and execution_status.

    A failed input gate comes first, then a failed skill gate, then a request without a tool; only then do policy, session
    and registry count. A tool that isn't registered is blocked. Tools themselves aren't run: where a runner has left
    `execution_ok`, an authorized request was executed or its execution failed.
    """
    tool = F.col("tool_name").isNotNull()
    registry = F.when(F.col("tool_name").isin(*registered), "allow").otherwise("block")
    merged = strictest(F.col("detection_decision"), F.col("policy_decision"), F.col("chain_decision"), registry, empty="block")
    input_failed, skill_failed = ~F.col("input_gate_passed"), ~F.col("skill_gate_passed")
    early = input_failed | skill_failed | ~tool
    final = F.when(early, F.col("detection_decision")).otherwise(merged)
    df = df.withColumn("final_decision", final)
    d, ran = F.col("final_decision"), F.col("execution_ok") if "execution_ok" in df.columns else F.lit(None).cast("boolean")
    status = (
        F.when(input_failed, F.when(d == "review", "input_review_required").otherwise("input_blocked"))
        .when(skill_failed, F.when(d == "review", "skill_review_required").otherwise("skill_blocked"))
        .when(~tool, "evaluated").when(d == "block", "blocked").when(d == "review", "pending_approval")
        .when(F.coalesce(F.col("execute"), F.lit(False)), F.when(ran, "executed").when(~ran, "execution_failed").otherwise("authorized")).otherwise("authorized_not_executed")
    )
    run = F.when(input_failed, "skipped_by_input_gate").when(skill_failed, "skipped_by_skill_gate").when(~tool, "not_requested").when(d == "block", "skipped_by_final_decision").when(d == "review", "pending_approval").when(F.coalesce(F.col("execute"), F.lit(False)), F.when(ran, "completed").when(~ran, "failed").otherwise("pending_final_decision")).otherwise("dry_run")
    return df.withColumn("status", status).withColumn("execution_status", run).withColumn("risk_level", level_of(d))


def unified(df: DataFrame, module: str, event_id: str = "event_id", structured: bool = False) -> DataFrame:
    """The nine fields of a verdict from an operator's columns (score in hundredths, decision, matches or matched_rules).

    A blank decision falls back to `actual_action` where that column is there. structured: evidence as structs of rule, category and texts, as tool verdicts have it.
    """
    rules = F.col("matched_rules") if "matched_rules" in df.columns else F.transform("matches", lambda m: m["rule_id"])
    if "matches" not in df.columns:
        evidence = F.array().cast("array<string>")
    elif structured:
        evidence = F.transform("matches", lambda m: F.struct(m["rule_id"].alias("rule_id"), m["category"].alias("category"), m["evidence"].alias("evidence")))
    else:
        evidence = F.flatten(F.transform("matches", lambda m: m["evidence"]))
    decision = F.col("decision")
    if "actual_action" in df.columns:
        decision = F.coalesce(F.when(F.trim(decision) != "", decision), F.col("actual_action"))
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    said = F.when(F.size(rules) == 0, "no rule matched").otherwise(F.array_join(F.slice(rules, 1, 4), "; "))
    return df.select(F.col(event_id).cast("string").alias("event_id"), F.lit(module).alias("module"), (F.col("score") / 100).alias("risk_score"), level_of(decision).alias("risk_level"), decision.alias("decision"), said.alias("reason"), rules.alias("matched_rules"), evidence.alias("evidence"), at.alias("timestamp"))


def validated(verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """Unified verdicts with `error`. A row with an empty id, a score outside 0 to 1, an unknown decision or level, or null lists is blocked and says so; strict: it raises."""
    bad = (F.coalesce("event_id", F.lit("")) == "") | ~F.col("risk_score").between(0, 1) | rank(F.col("decision"), DECISIONS).isNull() | rank(F.col("risk_level"), LEVELS).isNull() | F.col("matched_rules").isNull() | F.col("evidence").isNull()
    said = F.concat(F.lit("invalid verdict "), F.coalesce("event_id", F.lit("?")))
    df = verdicts.withColumn("error", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(said).cast("string") if strict else said))
    wrong = F.col("error").isNotNull()
    return df.withColumn("decision", F.when(wrong, DECISIONS[-1]).otherwise(F.col("decision"))).withColumn("risk_level", F.when(wrong, LEVELS[-1]).otherwise(F.col("risk_level")))


def merged(verdicts: DataFrame) -> DataFrame:
    """One verdict an event from several modules': the strictest decision, its level, the greatest score, all rules once in
    the order of modules."""
    item = F.struct("module", "matched_rules")
    per = verdicts.groupBy("event_id").agg(F.max(rank(F.col("decision"), DECISIONS)).alias("_d"), F.max("risk_score").alias("risk_score"), F.array_sort(F.collect_list(item)).alias("_r"))
    made = F.get(F.array(*map(F.lit, DECISIONS)), F.col("_d"))
    return per.select("event_id", "risk_score", made.alias("decision"), level_of(made).alias("risk_level"), F.array_distinct(F.flatten(F.transform("_r", lambda r: r["matched_rules"]))).alias("matched_rules"))
