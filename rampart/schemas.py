"""Row shapes and ordered enums of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered enums, lowest first. Compare ranks, never names.
DECISIONS = ("allow", "warn", "review", "block")
LEVELS = ("low", "medium", "high", "critical")
CLASSES = ("public", "internal", "sensitive", "secret")
SEVERITIES = ("info", "medium", "high", "critical")
SOURCE_TYPES = ("user", "web", "document", "email", "rag", "memory", "tool", "unknown")
TRUST_LEVELS = ("trusted", "untrusted", "unknown")

SOURCE = "source_id string, source_type string, trust_level string, classification string, origin string, content string"
TOOL_CALL = "case_id string, tool_name string, operation string, target string, arguments string, user_intent string"
PROMPT_ROW = "sample_id string, parent_id string, split string, label string, category string, variant string, input_text string"
VERDICT = "event_id string, module string, risk_score double, risk_level string, decision string, reason string, matched_rules array<string>, evidence array<string>, timestamp string"
SCAN = "scan_id string, related_event_id string, skill_name string, scan_status string, module string, risk_score double, risk_level string, decision string, reason string, matched_rules array<string>, evidence array<string>, timestamp string"
AUDIT = "sequence long, timestamp string, record string, previous_hash string, entry_hash string"
APPROVAL_EVENT = "approval_id string, action string, actor_id string, actor_role string, approve boolean, at timestamp, request_hash string"
PRINCIPAL = "user_id string, role string, department string, token_sha256 string"
RULE = "rule_id string, category string, description string, weight double, patterns array<string>"
FINDING = "rule_id string, severity string, file string, evidence string"


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place in the order from 0, null if it isn't in it."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, (at - 1).cast("int"))


def name(at: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, order)), at)


def strictest(*decisions: Column, empty: str = "allow") -> Column:
    """The strictest of some decisions; unknown and null ones don't count. empty: if none counts."""
    ranks = F.greatest(F.lit(-1), *(F.coalesce(rank(d, DECISIONS), F.lit(-1)) for d in decisions))
    return F.when(ranks < 0, F.lit(empty)).otherwise(name(ranks, DECISIONS))


def level_of(decision: Column) -> Column:
    return name(rank(decision, DECISIONS), LEVELS)


def highest_class(values: Column) -> Column:
    """Highest of an array of classifications, public if it is empty."""
    return name(F.coalesce(F.array_max(F.transform(values, lambda x: rank(x, CLASSES))), F.lit(0)), CLASSES)


def score_decision(points: Column) -> Column:
    """From a score in hundredths."""
    return F.when(points < 30, "allow").when(points < 60, "warn").when(points < 80, "review").otherwise("block")
