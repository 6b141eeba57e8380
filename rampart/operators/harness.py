"""Benchmarks of the detectors: cases in varied forms, their verdicts, and the figures of these."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..rules import PROMPT_RULES, TOOL_RULES, Rule
from ..sources.readers import prompt_variants
from .evaluate import accuracy_by, metrics, robustness
from .multisource import multisource_verdicts
from .prompt import prompt_verdicts
from .skills import skill_verdicts
from .tool import tool_verdicts

#: Ways in which a benchmark varies a call, and a source.
TOOL_VARIANTS = ("plain", "upper_tool", "target_noise", "argument_noise", "url_target", "base64_target", "nested_args", "reordered")
SKILL_VARIANTS = ("plain", "comment", "blank_line", "spaces", "result")


def _percent(text: Column) -> Column:
    """All but unreserved characters as escapes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _base64(text: Column) -> Column:
    return F.regexp_replace(F.base64(text.cast("binary")), "\\s", "")


def tool_variants(cases: DataFrame) -> DataFrame:
    """cases (case_id, tool_name, operation, target, arguments as JSON text of an object, expected_action) by each variant."""
    target, args = F.coalesce("target", F.lit("")), F.coalesce("arguments", F.lit("{}"))
    quoted = F.regexp_replace(F.to_json(F.array(target)), "^\\[|\\]$", "")
    entries = F.regexp_replace(F.trim(args), "^\\{\\s*|\\s*\\}$", "")
    noted = F.concat(F.lit('{"request_note":"normal workflow context"'), F.when(entries == "", "").otherwise(F.concat(F.lit(","), entries)), F.lit("}"))
    forms = {
        "plain": {}, "upper_tool": {"tool_name": F.upper("tool_name")}, "target_noise": {"target": F.concat(target, F.lit(" "))}, "argument_noise": {"arguments": noted},
        "url_target": {"target": _percent(target)}, "base64_target": {"target": _base64(target)}, "nested_args": {"arguments": F.concat(F.lit('{"payload":'), args, F.lit(',"target_copy":'), quoted, F.lit("}"))}, "reordered": {},
    }
    columns = ("tool_name", "operation", "target", "arguments")
    each = [F.struct(F.lit(v).alias("variant"), *(new.get(c, F.col(c)).alias(c) for c in columns)) for v, new in forms.items()]
    rows = cases.select("case_id", "expected_action", F.explode(F.array(*each)).alias("x")).select("case_id", "expected_action", "x.*")
    # Keys are written in order, so that a call reads alike in whatever order its arguments came.
    return rows.withColumn("arguments", canonical_json("arguments"))


def skill_variants(skills: DataFrame) -> DataFrame:
    """skills (case_id, expected, source) by each variant."""
    s = F.col("source")
    forms = {"plain": s, "comment": F.concat(F.lit("# plugin\n"), s), "blank_line": F.concat(F.lit("\n"), s), "spaces": F.concat(s, F.lit("\n\n")), "result": F.concat(s, F.lit("\nRESULT = 'done'\n"))}
    return skills.select("case_id", "expected", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("source")) for k, v in forms.items()))).alias("x")).select("case_id", "expected", "x.*")


def prompt_benchmark(bases: DataFrame, rules: Sequence[Rule] = PROMPT_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts of bases (parent_id, place, label, category, text) in all variants, metrics by split, and robustness by variant. What isn't allowed counts as detected."""
    rows = prompt_verdicts(prompt_variants(bases), "input_text", rules=rules)
    judged = rows.select("sample_id", "parent_id", "split", "category", "variant", "decision", (F.col("label") == "attack").alias("expected"), (F.col("decision") != "allow").alias("predicted"))
    return judged, metrics(judged, "split"), robustness(judged)


def tool_benchmark(cases: DataFrame, rules: Sequence[Rule] = TOOL_RULES) -> tuple[DataFrame, DataFrame]:
    """Verdicts of cases in all variants, and the accuracy of actions by variant."""
    judged = tool_verdicts(tool_variants(cases), rules).select("case_id", "variant", "expected_action", "decision", (F.col("decision") == F.col("expected_action")).alias("correct"))
    return judged, accuracy_by(judged, "variant")


def multisource_benchmark(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts of cases (case_id, label, sources, tool_name, operation, destination), and their metrics."""
    judged = multisource_verdicts(cases, "case_id").join(cases.select("case_id", "label"), "case_id").select("case_id", "decision", "matched_rules", (F.col("label") == "attack").alias("expected"), (F.col("decision") != "allow").alias("predicted"))
    return judged, metrics(judged)


def skill_benchmark(skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts of skills (case_id, expected: whether it is risky, source) in all variants, and their metrics."""
    judged = skill_verdicts(skill_variants(skills)).select("case_id", "variant", "calls", "decision", "expected", (F.col("decision") != "allow").alias("predicted"))
    return judged, metrics(judged)
