"""Queries on inputs that are larger or have more keys than the given tables."""

from __future__ import annotations

from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest

from rampart import registry
from rampart.operators import audit
from rampart.sources import readers, sinks


@pytest.fixture
def shifted(spark, sf, tmp_path):
    """The events with ids and users beyond those of the given tables, beside the given ones."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.unionByName(events.selectExpr("event_id + 1000000 AS event_id", "ts", "user_id + 100000 AS user_id", "event_type", "value", "props")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["report_summary", "display_stats"])
def test_ids_of_seven_digits_are_told_apart(spark, shifted, name):
    df = registry.queries()[name](spark, shifted)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{shifted}/events.parquet/*.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in df.collect()))) == sorted(map(str, rel.fetchall()))


class Kept:
    """State of one part, as a processor's handle gives it."""

    def __init__(self):
        self.map, self.list, self.value, self.timers = {}, [], None, set()

    def getMapState(self, *_):
        return self

    getListState = lambda self, *_: Kept()
    getValueState = lambda self, *_: Kept()
    getValue = lambda self, key: self.map.get(key)
    updateValue = lambda self, key, value: self.map.__setitem__(key, value)
    exists = lambda self: bool(self.list) or self.value is not None
    appendList = lambda self, rows: self.list.extend(rows)
    put = lambda self, rows: setattr(self, "list", list(rows))
    get = lambda self: self.value or iter(self.list)
    update = lambda self, value: setattr(self, "value", value)
    clear = lambda self: self.__init__()
    registerTimer = lambda self, ms: self.timers.add(ms)
    deleteTimer = lambda self, ms: self.timers.discard(ms)


def test_a_call_takes_all_sessions_of_a_part():
    from rampart.streaming.sessions import SessionTaint

    row = {"principal_id": "p", "odd": False, "operation": "read", "tool_name": "", "cls": 2, "outside": False, "no_destination": True, "credential": False, "sensitive": True}
    frame = lambda ts: pd.DataFrame([row | {"session_id": s, "event_id": 10 * ts + i, "ts": ts} for i, s in enumerate(("a", "b", None))])
    job = SessionTaint()
    job.init(Kept())
    (first,), (second,) = (list(job.handleInputRows((7,), iter([frame(ts)]), None)) for ts in (1, 2))
    assert sorted(first["session_id"].fillna("-")) == ["-", "a", "b"] and set(first["prior_class"]) == {0}
    assert set(second["prior_class"]) == {2} and set(second["prior_events"]) == {1}


def test_a_call_takes_all_chains_of_a_part():
    from rampart.operators.audit import linked_entry
    from rampart.streaming.chains import ChainHead

    job = ChainHead()
    job.init(Kept())
    job.handleInitialState((7,), pd.DataFrame({"chain": ["x"], "last_sequence": [4], "last_hash": ["h"]}), None)
    (got,) = job.handleInputRows((7,), iter([pd.DataFrame({"chain": ["x", None, "x"], "place": [2, 1, 1], "stamp": ["2", "1", "1"], "text": ["{}"] * 3})]), None)
    x = got[got["chain"] == "x"]
    assert list(x["sequence"]) == [5, 6] and list(got[got["chain"].isna()]["sequence"]) == [1]
    assert x["entry_hash"].iloc[0] == linked_entry("h", 5, "1", "{}")[1] and x["previous_hash"].iloc[1] == x["entry_hash"].iloc[0]


def test_one_timer_serves_all_approvals_of_a_part():
    from rampart.streaming.approvals import Approval

    handle, minute = Kept(), 60_000
    job = Approval(30, 60)
    job.init(handle)
    step = lambda a, ms, action, actor, approve=False: {"approval_id": a, "ms": ms, "seq": 0, "action": action, "actor_id": actor, "actor_role": "manager", "approve": approve, "request_hash": "p"}
    rows = [step("b", 2 * minute, "decide", "bob", True)] + [step(a, minute, "create", "ann") for a in "ab"]
    assert list(job.handleInputRows((7,), iter([pd.DataFrame(rows)]), None)) == [] and handle.timers == {minute}
    fire = lambda now: next(job.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: 0)), None)
    shown = lambda frame: sorted(zip(frame["approval_id"], frame["status"]))
    handle.timers.clear()
    assert shown(fire(3 * minute)) == [("a", "pending"), ("b", "approved"), ("b", "pending")]
    assert handle.timers == {31 * minute}
    handle.timers.clear()
    assert shown(fire(40 * minute)) == [("a", "expired"), ("b", "expired")]
    assert handle.timers == {100 * minute}
    handle.timers.clear()
    assert fire(100 * minute) is None and not job.state.list and not handle.timers


def test_chains_of_a_log_share_files(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS c", "id AS n", "CAST(id AS STRING) AS at", "'{}' AS record")
    for part in ("n % 2 = 0", "n % 2 = 1"):
        sinks.append_chain(rows.where(part), str(tmp_path / "log"), "c", ("n",), "at", "record")
    assert len(list((tmp_path / "log").rglob("*.json"))) <= 20
    assert readers.audit_log(spark, str(tmp_path / "log"), "c long").select("c").distinct().count() == 400


def test_records_are_made_before_a_chain_comes_together(spark):
    rows = spark.range(3).selectExpr("'all' AS c", "id AS n", "CAST(id AS STRING) AS at", "'{\"password\":\"x\"}' AS record")
    plan = audit.build_chain(rows, "c", ("n",), "at", "record")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression") < plan.index("ArrowEvalPython")
