"""Approvals of a stream by event time: steps are taken in the order of their times, whatever the order they come in.

A step waits in the state until the watermark has passed its time; an event-time timer then takes all steps up to the watermark. So
steps that come late, but within the watermark's delay, are judged as operators.approvals.approval_states() judges them
in a table. The same timer ends pending and approved approvals whose time is over, and clears what has been over for KEEP_MINUTES.

State and timer are for a part of all approvals: one timer at the part's next time, whereupon the part's open approvals and waiting
steps are read and written as lists. What is cleared is gone from them, so they hold no more than KEEP_MINUTES of approvals.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.approvals import DECIDERS, TTL_MINUTES
from .parts import part

KEEP_MINUTES = 24 * 60
OPEN = ("pending", "approved")
_END = 1 << 62
STEP = "approval_id string, action string, at timestamp, status string, decided_by string, accepted boolean"
_STATE = StructType([StructField(n, StringType()) for n in ("approval_id", "status", "requested_by", "request_hash", "decided_by")] + [StructField(n, LongType()) for n in ("expires", "ended")])
_WAITING = StructType([
    StructField("approval_id", StringType()), StructField("ms", LongType()), StructField("seq", LongType()), StructField("action", StringType()), StructField("actor_id", StringType()),
    StructField("actor_role", StringType()), StructField("approve", BooleanType()), StructField("request_hash", StringType()),
])


class Approval(StatefulProcessor):
    """status, requested_by, request_hash, decided_by and expires of a part's approvals, and the steps that wait for the watermark."""

    def __init__(self, ttl_minutes: int, keep_minutes: int):
        self.ttl, self.keep = ttl_minutes * 60_000, keep_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("approvals", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def _wake(self, ms: int) -> None:
        """The part's one timer, at the earliest of the times asked for."""
        there = self.timer.get()[0] if self.timer.exists() else None
        if there is None or ms < there:
            if there is not None:
                self.handle.deleteTimer(there)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        steps = []
        for frame in rows:
            for r in frame.itertuples(index=False) if len(frame) else ():
                text = [None if pd.isna(x) else str(x) for x in (r.approval_id, r.action, r.actor_id, r.actor_role, r.request_hash)]
                steps.append((text[0], int(r.ms), int(r.seq), *text[1:4], None if pd.isna(r.approve) else bool(r.approve), text[4]))
        if steps:
            self.waiting.appendList(steps)
            self._wake(min(s[1] for s in steps))
        return iter(())

    def _stepped(self, approval: str | None, kept: tuple, due: list[tuple], later: bool, now: int, out: list[tuple]) -> tuple | None:
        """The state of an approval (status to ended) after its steps up to now; null if there is none left."""
        status, by, print_, decided, expires, ended = kept
        was = status
        for ms, seq, action, actor, role, approve, given in [*due, (now, _END, None, None, None, None, None)]:
            if status in OPEN and ms >= expires:
                status = "expired"
                out.append((approval, "expire", expires, status, decided, True))
            if seq == _END:
                break
            accepted = True
            if action == "create" and status is None:
                status, by, print_, expires = "pending", actor, given, ms + self.ttl
            elif action == "decide" and status == "pending" and actor is not None and actor != by and role in DECIDERS:
                status, decided = "approved" if approve else "rejected", actor
            elif action == "consume" and status == "approved" and given == print_:
                status = "consumed"
            else:
                accepted = False
            out.append((approval, action, ms, status, decided, accepted))
        if status is not None and status not in OPEN and status != was:
            ended = now
        over = ended is not None and now >= ended + self.keep and not later
        return None if status is None or over else (status, by, print_, decided, expires, ended)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # All steps up to the watermark are here. Timers set from here on may not go off in this batch.
        now = max(int(timerValues.getCurrentWatermarkInMs()), int(expiredTimerInfo.getExpiryTimeInMs()))
        self.timer.clear()
        held: dict[str | None, tuple] = {}
        for approval, *kept in self.state.get() if self.state.exists() else ():
            held.setdefault(approval, tuple(kept))
        due, later = {}, []
        for step in sorted(map(tuple, self.waiting.get()), key=lambda s: s[1:3]) if self.waiting.exists() else ():
            if step[1] <= now:
                due.setdefault(step[0], []).append(step[1:])
            else:
                later.append(step)
        ahead = {s[0] for s in later}
        out: list[tuple] = []
        left = {a: self._stepped(a, held.get(a, (None,) * 6), due.get(a, []), a in ahead, now, out) for a in (held | due)}
        kept = [(a, *state) for a, state in left.items() if state is not None]
        self.state.put(kept) if kept else self.state.clear()
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        times = [s[1] for s in later] + [k[5] if k[1] in OPEN else k[6] + self.keep for k in kept]
        if (times := [t for t in times if t > now]):
            self._wake(min(times))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")])
            frame["at"] = pd.to_datetime(frame["at"], unit="ms", utc=True)
            yield frame

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Approvals from before the stream."""
        kept = []
        for r in initialState.itertuples(index=False):
            text = [None if pd.isna(x) else str(x) for x in (r.approval_id, r.status, r.requested_by, r.request_hash, r.decided_by)]
            kept.append((*text, int(r.expires), None if text[1] in OPEN else int(r.expires)))
        if kept:
            self.state.appendList(kept)
            self._wake(min(k[5] if k[1] in OPEN else k[6] + self.keep for k in kept))

    def close(self) -> None:
        pass


def stream_approvals(events: DataFrame, late: str = "10 minutes", snapshot: DataFrame | None = None, ttl_minutes: int = TTL_MINUTES, keep_minutes: int = KEEP_MINUTES) -> DataFrame:
    """STEP for each step of a stream of approval events (schemas.APPROVAL_EVENT with seq, which orders steps of one time), once the watermark has passed it, and for each expiry.

    snapshot: approval_id, status, requested_by, request_hash, decided_by and expires_at of approvals from before, read when
    the stream first starts. Steps that come later than `late` are dropped, as the watermark has passed them. Null times are
    dropped. Needs the RocksDB state store.
    """
    rows = events.where(F.col("at").isNotNull()).withWatermark("at", late)
    rows = rows.select(part("approval_id"), "approval_id", "at", F.unix_millis("at").alias("ms"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "action", "actor_id", "actor_role", "approve", "request_hash")
    start = None
    if snapshot is not None:
        start = snapshot.select(part("approval_id"), "approval_id", "status", "requested_by", "request_hash", "decided_by", F.unix_millis("expires_at").alias("expires")).groupBy("part")
    return rows.groupBy("part").transformWithStateInPandas(Approval(ttl_minutes, keep_minutes), STEP, "Append", "EventTime", initialState=start)
