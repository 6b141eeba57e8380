"""Tool-call verdicts, aliases of tool names, and the scope of permission a call needs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base64_decoded, compact, nfkc, squeezed, url_decoded
from ..rules import TOOL_RULES, Rule
from ..schemas import level_of, score_decision
from .rule_index import RuleIndex, hits, matching
from .scoring import active, bonuses, has, met_maxima, points, settled

CATEGORIES = tuple(dict.fromkeys(r.category for r in TOOL_RULES))


def alias(tool: Column, method: Column) -> Column:
    """The policy's name of a tool: shells are one, requests go by their method."""
    t = F.lower(F.trim(tool))
    return F.when(t.isin("shell_exec", "terminal", "bash", "cmd", "powershell"), "shell").when(t == "http_request", F.when(F.upper(method).isin("POST", "PUT", "PATCH", "DELETE"), "http_post").otherwise("http_get")).otherwise(t)


def invocation(tool: Column, operation: Column, target: Column, arguments: Column) -> Column:
    """A call as the lines that rules read."""
    line = lambda k, v: F.concat(F.lit(k + ": "), F.coalesce(v, F.lit("")))
    return F.concat_ws("\n", line("tool_name", tool), line("operation", operation), line("target", target), line("arguments", arguments))


def tool_bonus(categories: Column, decoded: Column) -> Column:
    c = categories
    either = lambda *names: F.arrays_overlap(c, F.array(*map(F.lit, names)))
    return bonuses([
        (has(c, "sensitive_file_access", "data_exfiltration"), 16), (has(c, "credential_access") & either("data_exfiltration", "external_request"), 18),
        (has(c, "dangerous_command", "destructive_operation"), 12), (has(c, "permission_bypass") & either("dangerous_command", "unauthorized_tool", "sensitive_file_access"), 12),
        (has(c, "audit_evasion") & either("dangerous_command", "destructive_operation"), 10), (has(c, "external_request", "data_exfiltration"), 10),
        (decoded & (F.size(c) > 0), 4), (F.size(c) >= 3, 4),
    ])


def scope(categories: Column) -> Column:
    either = lambda *names: F.arrays_overlap(categories, F.array(*map(F.lit, names)))
    return (
        F.when(either("dangerous_command", "destructive_operation"), "system").when(either("credential_access", "sensitive_file_access"), "sensitive_data")
        .when(either("data_exfiltration", "external_request"), "network").when(either("unauthorized_tool", "permission_bypass"), "privileged_tool").when(either("audit_evasion"), "audit").otherwise("normal")
    )


def _break(regexes: Iterable[str]) -> str:
    """What stands between views that are matched together. A call is several lines, so dots cross them; no counted run of dots crosses so many characters."""
    widest = max((int(n) for r in regexes for n in re.findall(r"\{\d*,(\d+)\}", r)), default=0)
    return "\n" + "\0" * (widest + 1) + "\n"


def text_verdicts(rows: DataFrame, text: str, rules: Sequence[Rule] | DataFrame = TOOL_RULES, full: bool = False) -> DataFrame:
    """rows with matches, categories, score (hundredths), decision, risk_level and permission_scope of a text column."""
    index = RuleIndex.of(rows.sparkSession, rules, True, constant=True)
    source, between = F.coalesce(F.col(text), F.lit("")), _break(index.regexes)
    # ASCII is its own NFKC form and needs no UDF.
    df = rows.withColumn("_nfkc", F.coalesce(nfkc(F.when(source.rlike("[^\\x00-\\x7f]"), source)), source) if full else source).withColumn("_plain", squeezed(F.col("_nfkc")))
    decoded = F.concat(F.array_compact(F.array(squeezed(url_decoded(F.col("_plain"))))), base64_decoded(F.col("_nfkc")))
    df = settled(df.withColumn("_decoded", F.array_join(decoded, between)))
    close = F.when(F.length(compact(F.col("_plain"))) >= 6, compact(F.col("_plain")))
    df = df.withColumn("_all", F.array_join(F.array_distinct(F.array_compact(F.array(F.lower(source), "_plain", close, F.lower("_decoded")))), between))
    df = settled(df)
    df = df.withColumn("_candidates", index.candidates(F.col("_all")))
    df = settled(df.withColumn("_matching", matching(F.col("_all"), F.col("_candidates"), index.constants)))
    df = settled(df.withColumn("matches", hits(F.col("_all"), F.col("_matching"), length=140, constants=index.constants)))
    df = df.withColumn("_in_decoded", (F.size("matches") > 0) & (F.size(matching(F.lower("_decoded"), F.col("_matching"), index.constants)) > 0))
    df = df.withColumn("_maxima", met_maxima(F.col("matches"))).withColumn("categories", active(F.col("_maxima")))
    df = df.withColumn("score", points(F.col("_maxima"), 12, tool_bonus(F.col("categories"), F.col("_in_decoded"))))
    df = df.withColumn("decision", score_decision(F.col("score"))).withColumn("risk_level", level_of(F.col("decision"))).withColumn("permission_scope", scope(F.col("categories")))
    return settled(df.drop("_nfkc", "_plain", "_decoded", "_in_decoded", "_all", "_maxima", "_candidates", "_matching"))


def tool_verdicts(calls: DataFrame, rules: Sequence[Rule] | DataFrame = TOOL_RULES, full: bool = True) -> DataFrame:
    """Verdicts of calls (tool_name, operation, target, arguments as JSON text)."""
    return text_verdicts(calls.withColumn("_call", invocation(F.col("tool_name"), F.col("operation"), F.col("target"), F.col("arguments"))), "_call", rules, full).drop("_call")
