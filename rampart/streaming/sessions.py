"""Streams: session state, approvals with a time to live, appends that don't repeat, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType, TimestampType

from ..functions.text import external
from ..operators.approvals import DECIDERS, TTL_MINUTES
from ..operators.session import CREDENTIAL, KEPT, LONG_AFTER, LONG_CHAIN, OUTBOUND, READS, SENSITIVE
from ..schemas import CLASSES, rank
from .parts import named, part

CHAIN = "session_id string, event_id long, prior_class int, prior_credential boolean, prior_sensitive boolean, prior_events int, chain_rules array<string>, chain_decision string"


class SessionTaint(StatefulProcessor):
    """The state of session_verdicts(), kept by session in the map of its part: its owner, highest class read, two flags and the number of rows so far."""

    def __init__(self, carry: bool = False):
        self.columns = [c.split()[0] for c in CHAIN.split(", ")] + ["payload"] * carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("taint", StructType([StructField("session", StringType())]), StructType([StructField("highest", IntegerType()), StructField("credential", BooleanType()), StructField("sensitive", BooleanType()), StructField("events", IntegerType()), StructField("owner", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out, held = [], {}
        for r in pd.concat(rows).sort_values(["ts", "event_id"]).itertuples():
            session = None if pd.isna(r.session_id) else r.session_id
            if session not in held:
                kept = self.state.getValue(named(session))
                held[session] = (0, False, False, 0, None) if kept is None else tuple(kept)
            cls, credential, sensitive, events, owner = held[session]
            principal = None if pd.isna(r.principal_id) else str(r.principal_id)
            owner = principal if events == 0 else owner
            rules, decision = [], "allow"
            outbound = r.operation in OUTBOUND or r.tool_name == "http_post"
            if r.outside and outbound and cls >= 1:
                rules, decision = ["task_chain_classified_read_then_external_write"], "block"
            if r.outside and outbound and credential:
                rules, decision = [*rules, "task_chain_credential_access_then_external_write"], "block"
            if outbound and r.no_destination and sensitive and decision != "block":
                rules, decision = [*rules, "task_chain_sensitive_access_then_unscoped_write"], "review"
            if min(events, KEPT) >= LONG_AFTER and r.operation in LONG_CHAIN and decision == "allow":
                rules, decision = ["long_high_impact_task_chain"], "review"
            if r.odd:
                rules, decision = ["unknown_classification", *rules], "block"
            if principal != owner:
                rules, decision = ["session_of_another_principal"], "block"
            out.append((session, r.event_id, cls, credential, sensitive, events, rules, decision, *([r.payload] if "payload" in self.columns else [])))
            if principal != owner:
                held[session] = (cls, credential, sensitive, events, owner)
                continue
            if r.operation in READS:
                cls = max(cls, int(r.cls))
            held[session] = (cls, credential or bool(r.credential), sensitive or bool(r.sensitive), events + 1, owner)
        for session, kept in held.items():
            self.state.updateValue(named(session), kept)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, suffixes: tuple[str, ...] = (".gov.cn",), carry: tuple[str, ...] = ()) -> DataFrame:
    """session_verdicts() over a stream, in order of arrival by batch and of ts and event_id within one. Patterns are
    matched before the rows reach Python. carry: columns that come back as JSON in `payload`. Needs the RocksDB state store."""
    text = F.coalesce(F.col("input_text"), F.lit(""))
    known = rank(F.lower("classification"), CLASSES)
    cls = F.coalesce(known, F.lit(len(CLASSES) - 1))
    rows = events.select(
        F.col("principal_id").cast("string").alias("principal_id"), known.isNull().alias("odd"), *([F.to_json(F.struct(*carry)).alias("payload")] if carry else []),
        part("session_id"), F.col("session_id").cast("string").alias("session_id"), F.col("event_id").cast("long").alias("event_id"), "ts", F.lower("operation").alias("operation"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), cls.alias("cls"),
        external(F.col("destination"), F.array(*map(F.lit, suffixes))).alias("outside"), (F.trim(F.coalesce("destination", F.lit(""))) == "").alias("no_destination"),
        text.rlike(CREDENTIAL).alias("credential"), (text.rlike(SENSITIVE) | (cls >= 1)).alias("sensitive"),
    )
    return rows.groupBy("part").transformWithStateInPandas(SessionTaint(bool(carry)), CHAIN + ", payload string" * bool(carry), "Append", "None")


APPROVAL = "approval_id string, action string, status string, accepted boolean"


class ApprovalLife(StatefulProcessor):
    """An approval's status; a timer ends it when its time is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("approval", StructType([StructField("status", StringType()), StructField("requested_by", StringType()), StructField("request_hash", StringType()), StructField("expires_at", TimestampType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, by, print_, expires = tuple(self.state.get()) if self.state.exists() else (None, None, None, None)
        out = []
        for r in pd.concat(rows).sort_values(["at"]).itertuples():
            if status in ("pending", "approved") and r.at >= expires:
                status = "expired"
            accepted = True
            if r.action == "create" and status is None:
                status, by, print_, expires = "pending", r.actor_id, r.request_hash, (r.at + pd.Timedelta(minutes=TTL_MINUTES)).to_pydatetime()
                self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs()) + TTL_MINUTES * 60_000)
            elif r.action == "decide" and status == "pending" and r.actor_id != by and r.actor_role in DECIDERS:
                status = "approved" if r.approve else "rejected"
            elif r.action == "consume" and status == "approved" and r.request_hash == print_:
                status = "consumed"
            else:
                accepted = False
            out.append((key[0], r.action, status, accepted))
        if status is not None:
            self.state.update((status, by, print_, expires))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in APPROVAL.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rows = []
        if self.state.exists():
            status, *rest = tuple(self.state.get())
            if status in ("pending", "approved"):
                self.state.update(("expired", *rest))
                rows.append((key[0], "expire", "expired", True))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in APPROVAL.split(", ")])

    def close(self) -> None:
        pass


def stream_approvals(events: DataFrame) -> DataFrame:
    """approval_id, action, status and accepted of a stream of approval events. Consumption is accepted once.

    While timers are open the query has work to come, so a trigger of what is available now doesn't end by itself.
    """
    return events.groupBy("approval_id").transformWithStateInPandas(ApprovalLife(), APPROVAL, "Append", "ProcessingTime")


def once(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, at: str = "ts", by: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Rows by window and value. Windows close when the watermark has passed them."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", at: str = "ts", by: str = "user_id", late: str = "2 hours") -> DataFrame:
    """Rows by value and stretch without a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
