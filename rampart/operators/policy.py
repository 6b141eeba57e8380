"""Access policy: a decision from who asks for what, where, on which class of data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import external
from ..schemas import CLASSES, rank, strictest

REQUIRED = ("role_clearance", "role_allowed_operations", "tool_risk", "trusted_destination_suffixes", "production_review_operations", "always_review_tools", "always_block_tools", "destructive_operations")


@dataclass(frozen=True)
class Policy:
    """The default policy. Another can be read from JSON of the same keys."""

    role_clearance: dict[str, str] = field(default_factory=lambda: {"guest": "public", "employee": "internal", "manager": "sensitive", "security_admin": "secret"})
    role_allowed_operations: dict[str, list[str]] = field(
        default_factory=lambda: {
            "guest": ["read", "search"],
            "employee": ["read", "search", "create", "update"],
            "manager": ["read", "search", "create", "update", "export"],
            "security_admin": ["read", "search", "create", "update", "export", "delete", "execute"],
        }
    )
    tool_risk: dict[str, str] = field(default_factory=lambda: {"public_search": "low", "knowledge_search": "low", "file_read": "medium", "file_write": "medium", "http_get": "medium", "http_post": "high", "database": "high", "shell": "critical"})
    trusted_destination_suffixes: tuple[str, ...] = (".gov.cn",)
    production_review_operations: tuple[str, ...] = ("create", "update", "export", "delete", "execute")
    always_review_tools: tuple[str, ...] = ("http_post", "database")
    always_block_tools: tuple[str, ...] = ("shell",)
    destructive_operations: tuple[str, ...] = ("delete", "drop", "truncate", "execute")


def read_policy(spark: SparkSession, path: str) -> Policy:
    found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if missing := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"policy lacks {', '.join(missing)}")
    return Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in REQUIRED})


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """user_id, role, department and token_sha256 of a JSON document {"users": [...]}; repeated users or digests raise."""
    users = json.loads(spark.read.text(path, wholetext=True).first()["value"])["users"]
    for key in ("user_id", "token_sha256"):
        if len({u[key] for u in users}) != len(users):
            raise ValueError(f"repeated {key}")
    if bad := [u["user_id"] for u in users if u["role"] not in Policy().role_clearance]:
        raise ValueError(f"unknown role of {bad}")
    return spark.createDataFrame([(u["user_id"], u["role"], u.get("department", ""), u["token_sha256"]) for u in users], "user_id string, role string, department string, token_sha256 string")


def authenticated(requests: DataFrame, identities: DataFrame, token: str = "token", max_rows: int = 100_000) -> DataFrame:
    """requests with the identity whose digest is that of their token, nulls if there is none."""
    side = F.broadcast(identities) if identities.limit(max_rows + 1).count() <= max_rows else identities
    return requests.withColumn("token_sha256", F.sha2(token, 256)).join(side, "token_sha256", "left").drop("token_sha256", token)


def _is(value: Column, names) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def policy_verdicts(requests: DataFrame, policy: Policy | None = None, strict: bool = False) -> DataFrame:
    """requests (role, tool_name, operation, classification, environment, destination) with policy_findings and policy_decision.

    An unknown role is blocked before all else. An unknown classification is a finding that blocks; strict: it raises.
    """
    p = policy or Policy()
    clearance = F.coalesce(*(F.when(F.col("role") == r, CLASSES.index(c)) for r, c in p.role_clearance.items()))
    permitted = F.coalesce(*(F.when(F.col("role") == r, F.col("operation").isin(*ops)) for r, ops in p.role_allowed_operations.items()), F.lit(False))
    cls = rank(F.col("classification"), CLASSES)
    odd = cls.isNull()
    if strict:
        cls = F.when(odd, F.raise_error(F.lit("unknown classification")).cast("int")).otherwise(cls)
    outside = external(F.col("destination"), F.array(*map(F.lit, p.trusted_destination_suffixes)))
    blocked = _is(F.col("tool_name"), p.always_block_tools)
    rules = [
        (odd, "unknown_classification", "block"),
        (cls > clearance, "classification_exceeds_clearance", "block"),
        (~permitted, "operation_not_permitted_for_role", "block"),
        (~_is(F.col("tool_name"), p.tool_risk), "unknown_tool_requires_review", "review"),
        (blocked, "tool_disabled_by_policy", "block"),
        (~blocked & _is(F.col("tool_name"), p.always_review_tools), "high_risk_tool_requires_approval", "review"),
        (_is(F.col("operation"), p.destructive_operations), "destructive_operation_requires_approval", "review"),
        ((F.col("environment") == "production") & _is(F.col("operation"), p.production_review_operations), "production_change_requires_approval", "review"),
        (outside & (cls >= 1), "classified_data_external_destination", "block"),
        (outside & (cls < 1) & _is(F.col("operation"), ("export", "create", "update")), "external_write_requires_approval", "review"),
    ]
    known = F.coalesce(F.col("role").isin(*p.role_clearance), F.lit(False))
    found = F.array_compact(F.array(*(F.when(c, F.lit(i)) for c, i, _ in rules)))
    found = F.when(~known, F.array(F.lit("unknown_role"))).when(F.size(found) == 0, F.array(F.lit("policy_satisfied"))).otherwise(found)
    decided = F.when(~known, "block").otherwise(strictest(*(F.when(c, F.lit(d)) for c, _, d in rules)))
    return requests.withColumn("policy_findings", found).withColumn("policy_decision", decided)
