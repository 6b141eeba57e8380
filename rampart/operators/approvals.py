"""Approvals as a fold of their events: pending, approved, rejected, expired, consumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import Policy, policy_verdicts

DECIDERS = ("manager", "security_admin")
TTL_MINUTES = 30


def approval_states(events: DataFrame, now: str | None = None, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """approval_id, status, requested_by, decided_by, consumed_at and refused (steps that weren't allowed).

    events: approval_id, seq, action (create, decide, consume), actor_id, actor_role, approve, at, request_hash. A decision
    needs a pending approval, another actor than the requester and a deciding role. Consumption needs an approved one that
    hasn't expired, once, with the fingerprint it was made for. An approval's events are few, so they are folded in one row.
    """
    row = F.struct("at", "seq", "action", "actor_id", "actor_role", "approve", "request_hash")
    held = events.groupBy("approval_id").agg(F.array_sort(F.collect_list(row)).alias("_e"))
    state = F.struct(
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("requested_by"), F.lit(None).cast("string").alias("decided_by"), F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit(None).cast("timestamp").alias("consumed_at"), F.lit(None).cast("string").alias("request_hash"), F.lit(0).alias("refused"),
    )

    def step(s, e):
        late = F.coalesce(e["at"] >= s["expires_at"], F.lit(False)) & s["status"].isin("pending", "approved")
        status = F.when(late, "expired").otherwise(s["status"])
        create = (e["action"] == "create") & s["status"].isNull()
        decide = (e["action"] == "decide") & F.coalesce((status == "pending") & (e["actor_id"] != s["requested_by"]) & e["actor_role"].isin(*DECIDERS), F.lit(False))
        consume = (e["action"] == "consume") & F.coalesce((status == "approved") & e["request_hash"].eqNullSafe(s["request_hash"]), F.lit(False))
        return F.struct(
            F.when(create, "pending").when(decide, F.when(e["approve"], "approved").otherwise("rejected")).when(consume, "consumed").otherwise(status).alias("status"),
            F.when(create, e["actor_id"]).otherwise(s["requested_by"]).alias("requested_by"),
            F.when(decide, e["actor_id"]).otherwise(s["decided_by"]).alias("decided_by"),
            F.when(create, e["at"] + F.make_dt_interval(mins=F.lit(ttl_minutes))).otherwise(s["expires_at"]).alias("expires_at"),
            F.when(consume, e["at"]).otherwise(s["consumed_at"]).alias("consumed_at"),
            F.when(create, e["request_hash"]).otherwise(s["request_hash"]).alias("request_hash"),
            (s["refused"] + F.when(create | decide | consume, 0).otherwise(1)).alias("refused"),
        )

    done = held.select("approval_id", F.aggregate("_e", state, step).alias("_s")).select("approval_id", "_s.*")
    if now is not None:
        late = F.col("status").isin("pending", "approved") & (F.lit(now).cast("timestamp") >= F.col("expires_at"))
        done = done.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))
    return done.drop("expires_at", "request_hash")


def rechecked(approved: DataFrame, policy: Policy | None = None, registered: tuple[str, ...] | None = None) -> DataFrame:
    """approved requests (the columns that policy_verdicts() reads) with policy_findings, policy_decision and `refusal`: why one may not be run now, null if it may."""
    p = policy or Policy()
    known = F.col("tool_name").isin(*(registered if registered is not None else p.tool_risk))
    df = policy_verdicts(approved, p)
    return df.withColumn("refusal", F.when(~F.coalesce(known, F.lit(False)), "tool is no longer registered").when(F.col("policy_decision") == "block", "policy now blocks the request"))
