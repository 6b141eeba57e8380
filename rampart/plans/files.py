"""Queries that write files to the shared folder and read them back, and streams over them; each with its SQL."""

from __future__ import annotations

import contextlib
import io
import json
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.approvals import TTL_MINUTES
from ..operators import audit, packages, policy, report, session, skills
from ..rules import merged_table
from ..schemas import RULE, VERDICT
from ..sources import readers, sinks
from ..sources.shared import materialised, put, shared_folder
from ..streaming import approvals as approvals_stream
from ..streaming import chains, requests, sessions
from .oracles import APPROVALS, CHAIN, POLICY, TAINT
from .queries import _approval_events, _requests, pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")


@query("SELECT event_id, user_id, event_type, props FROM events")
def jsonl_scan(spark, sf):
    path = shared_folder(spark, "jsonl")
    _events(spark, sf).drop("value").write.json(path)
    return readers.json_lines(spark, path, "event_id long, user_id long, event_type string, props string")


@query("SELECT item_id::VARCHAR AS case_id, md5(text) AS md5, CASE item_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'attack' ELSE 'boundary' END AS case_type FROM benchmark")
def case_library(spark, sf):
    """Libraries of cases, a document each, written and read by Spark."""
    path = shared_folder(spark, "cases")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), pick(("normal", "attack", "boundary"), F.col("item_id") % 3).alias("case_type"), F.struct("text").alias("payload"))
    library = rows.groupBy(F.pmod(F.xxhash64("case_id"), F.lit(64)).alias("library"), F.floor(F.col("case_id").cast("long") / 6400).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("cases"))
    library.select("library", "part", F.to_json(F.struct("cases")).alias("value")).write.partitionBy("library", "part").text(path)
    held = readers.cases(spark, path, "case_id string, case_type string, payload struct<text:string>", least=10, required=("case_type", "payload"), kinds=("case_type", ("normal", "attack", "boundary")))
    return held.select("case_id", F.md5("payload.text").alias("md5"), "case_type")


#: Documents of a folder: one for each so many users.
_FOLDER = "SELECT user_id % 200 AS part, count(*) AS n FROM events GROUP BY part"


def _documents(spark, sf, good: Column, label: str) -> str:
    """A folder of JSON documents, one for each part, every eighth of them broken, written by Spark."""
    path = shared_folder(spark, label)
    rows = table(spark, sf, "events").groupBy((F.col("user_id") % 200).alias("part")).agg(F.count("*").alias("n"))
    value = F.when(F.col("part") % 8 > 0, F.to_json(good)).otherwise("{not json")
    rows.select(F.col("part").alias("document"), value.alias("value")).write.partitionBy("document").text(path)
    return path


def _verdict_documents(spark, sf) -> str:
    return _documents(spark, sf, F.struct(F.format_string("EVT-20260101-%03d", "part").alias("event_id"), F.col("n").cast("string").alias("module"), F.lit(0.5).alias("risk_score"), F.array(F.lit("a")).alias("matched_rules")), "records")


@query(f"WITH d AS ({_FOLDER}) SELECT part AS document, CASE WHEN part % 8 = 0 THEN 'json_read_error' ELSE 'missing_fields' END AS issue FROM d")
def record_folder_issues(spark, sf):
    held, broken = readers.records(spark, _verdict_documents(spark, sf), pattern="part-*")
    found = report.quality_issues(held).where("issue = 'missing_fields'").select("file", "issue").unionByName(broken)
    return found.select(F.regexp_extract("file", "document=([0-9]+)", 1).cast("long").alias("document"), "issue")


@query(f"WITH d AS ({_FOLDER}) SELECT part, n FROM d WHERE part % 8 > 0")
def lenient_folder(spark, sf):
    held = readers.lenient_records(spark, _verdict_documents(spark, sf), VERDICT, "part-*")
    return held.where("event_id IS NOT NULL").select(F.regexp_extract("event_id", "([0-9]+)$", 1).cast("long").alias("part"), F.col("module").cast("long").alias("n"))


@query(f"WITH d AS ({_FOLDER}) SELECT 'APR-' || part AS approval_id, n::VARCHAR AS requested_by FROM d WHERE part % 3 = 1 AND part % 8 > 0")
def approval_folder(spark, sf):
    good = F.struct(F.format_string("APR-%d", "part").alias("approval_id"), pick(("pending", "approved", "rejected"), F.col("part") % 3).alias("status"), F.format_string("2026-01-01T00:00:%02d", F.col("part") % 60).alias("created_at"), F.col("n").cast("string").alias("requested_by"))
    return readers.approvals(spark, _documents(spark, sf, good, "approvals"), "approved", "part-*").select("approval_id", "requested_by")


@query("SELECT event_id, user_id FROM events")
def csv_append_once(spark, sf):
    """Two appends that overlap leave each id once."""
    path, e = shared_folder(spark, "csv"), _events(spark, sf).select("event_id", "user_id")
    sinks.append_new(e.where("event_id % 3 < 2"), path, "event_id", "csv")
    sinks.append_new(e, path, "event_id", "csv")
    return spark.read.csv(path, header=True, schema="event_id long, user_id long")


@query("SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 2 = 0 THEN 'a | b' ELSE '' END AS rules, coalesce(event_type, '') AS kind, '{\"x\":' || event_id || '}' AS inner FROM events")
def csv_cells(spark, sf):
    path = shared_folder(spark, "cells")
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("rules"), F.col("event_type").alias("kind"), F.struct(F.col("event_id").alias("x")).alias("inner"))
    sinks.write_csv(e, path)
    return spark.read.csv(path, header=True, escape='"', schema="event_id string, rules string, kind string, inner string").fillna("")


@query("SELECT item_id, md5(text) AS md5, length(text)::BIGINT AS n_chars FROM benchmark")
def whole_texts(spark, sf):
    """A file for each text, written and read by Spark. The writer ends each with a line end."""
    path = shared_folder(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    held = readers.text_files(spark, path).select(F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.regexp_replace("value", "\n$", "").alias("value"))
    return held.select("item_id", F.md5("value").alias("md5"), F.length("value").cast("long").alias("n_chars"))


_LINES = ("print(1)", "import os\nos.system('ls')", "import requests as r\nr.post('https://x')", "eval(input())", "open('.env')")
#: Documents that go into an archive.
_PACKED = 100


def _zips(spark, sf) -> DataFrame:
    """path and content of archives made of documents, _PACKED each: texts, some of which leave their folder or repeat a name, sources and requirements."""

    def packed(group):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in sorted(zip(group["doc_id"], group["text"], strict=True)):
                z.writestr(f"../d{i}.txt" if i % 19 == 0 else f"d{i}.txt", text or "")
                if i % 7 == 0:
                    z.writestr(f"m{i}.py", _LINES[i % 5])
                if i % 11 == 0:
                    z.writestr(f"r{i}/requirements.txt", "a>=1\n-e .\nb @ https://x/y.whl\n" if i % 2 else "flask==1.0\n")
                if i % 23 == 0 and i % 19:
                    z.writestr(f"D{i}.TXT", "again")
        return pd.DataFrame({"path": [f"/p{int(group['pack'].iloc[0]):06d}.zip"], "content": [held.getvalue()]})

    docs = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / _PACKED).alias("pack"))
    return docs.groupBy("pack").applyInPandas(packed, "path string, content binary")


_PACK = f"d AS (SELECT doc_id AS i, 'p' || lpad((doc_id // {_PACKED})::VARCHAR, 6, '0') || '.zip' AS package FROM documents)"
_FOUND = """f AS (SELECT package, 'archive_path_traversal' AS rule_id, 'critical' AS severity, '../d' || i || '.txt' AS file FROM d WHERE i % 19 = 0
UNION ALL SELECT package, 'archive_duplicate_path', 'high', 'D' || i || '.TXT' FROM d WHERE i % 23 = 0 AND i % 19 > 0
UNION ALL SELECT package, 'dangerous_python_behavior', ['high', 'medium', 'critical', 'high'][(i % 5)::INT], 'm' || i || '.py' FROM d WHERE i % 7 = 0 AND i % 5 > 0
UNION ALL SELECT package, unnest(['dependency_not_exactly_pinned', 'dependency_source_override', 'direct_url_dependency']), unnest(['medium', 'high', 'high']), 'r' || i || '/requirements.txt' FROM d WHERE i % 11 = 0 AND i % 2 = 1)"""


@query(f"WITH {_PACK}, {_FOUND} SELECT * FROM f")
def archive_findings(spark, sf):
    """Findings in archives of all documents."""
    found = packages.package_findings(packages.archive_files(_zips(spark, sf)))
    return found.select(F.regexp_extract("package", "([^/]+)$", 1).alias("package"), "rule_id", "severity", "file")


_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(f"""WITH {_PACK}, {_FOUND}, p AS (SELECT package, count(*) + count(*) FILTER (WHERE i % 7 = 0) + count(*) FILTER (WHERE i % 11 = 0) - count(*) FILTER (WHERE i % 19 = 0) AS files FROM d GROUP BY package),
g AS (SELECT p.package, p.files, count(rule_id) AS findings, coalesce(max({_RANK}), 0) AS worst, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'critical') AS n_critical FROM p LEFT JOIN f USING (package) GROUP BY p.package, p.files)
SELECT package, ['allow', 'warn', 'review', 'block'][worst + 1] AS decision, least(100, [0, 35, 65, 90][worst + 1] + 2 * greatest(findings - 1, 0))::BIGINT AS score, findings, n_high, n_critical, files FROM g""")
def archive_verdicts(spark, sf):
    df = packages.package_verdicts(packages.archive_files(_zips(spark, sf)))
    return df.select(F.regexp_extract("package", "([^/]+)$", 1).alias("package"), "decision", F.col("score").cast("long").alias("score"), "findings", "n_high", "n_critical", "files")


@query("SELECT module, [0, 65, 30, 85, 65][(module % 5 + 1)::INT]::BIGINT AS score, n FROM (SELECT doc_id % 60 AS module, count(*) AS n FROM documents GROUP BY 1)")
def python_folder(spark, sf):
    """Sources written by Spark, a folder for each, that end in a comment of how many documents are theirs."""
    path = shared_folder(spark, "sources")
    rows = table(spark, sf, "documents").groupBy((F.col("doc_id") % 60).alias("module")).agg(F.count("*").alias("n"))
    rows.select("module", F.concat(pick(_LINES, F.col("module") % 5), F.lit("\n# "), F.col("n").cast("string")).alias("value")).write.partitionBy("module").text(path)
    df = skills.skill_verdicts(readers.python_tree(spark, path, pattern="part-*"))
    return df.select(F.regexp_extract("path", "module=([0-9]+)", 1).cast("long").alias("module"), F.col("score").cast("long").alias("score"), F.regexp_extract("source", "# ([0-9]+)", 1).cast("long").alias("n"))


def _word_pack(spark, sf, odd: int, weight: float) -> DataFrame:
    words = table(spark, sf, "conversations").where(F.col("conv_id") % 2 == odd).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 5").distinct()
    return words.select(F.col("w").alias("rule_id"), F.lit("jailbreak").alias("category"), F.lit("").alias("description"), F.lit(weight).alias("weight"), F.array("w").alias("patterns"))


@query("""WITH w AS (SELECT DISTINCT conv_id % 2 AS odd, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations), a AS (SELECT w FROM w WHERE odd = 0 AND length(w) >= 5), b AS (SELECT w FROM w WHERE odd = 1 AND length(w) >= 5)
SELECT coalesce(a.w, b.w) AS rule_id, CASE WHEN b.w IS NULL THEN 40 ELSE 70 END::BIGINT AS weight FROM a FULL JOIN b ON a.w = b.w""")
def rule_pack_merge(spark, sf):
    """A pack from a folder of JSON replaces rules of the same id and adds others: packs of words of conversations, whole."""
    path = shared_folder(spark, "pack")
    _word_pack(spark, sf, 1, 0.7).write.json(path)
    both = merged_table(_word_pack(spark, sf, 0, 0.4), spark.read.schema(RULE).json(path))
    return both.select("rule_id", F.round(F.col("weight") * 100).cast("long").alias("weight"))


@query("SELECT event_id, CASE WHEN user_id % 4 < 3 THEN 'u' || (user_id % 4) END AS user, CASE user_id % 4 WHEN 0 THEN 'guest' WHEN 1 THEN 'employee' WHEN 2 THEN 'manager' END AS role FROM events")
def token_identities(spark, sf):
    import hashlib

    path = shared_folder(spark, "identities")
    users = [{"user_id": f"u{k}", "role": r, "token_sha256": hashlib.sha256(f"token-{k}".encode()).hexdigest()} for k, r in enumerate(("guest", "employee", "manager"))]
    put(spark, f"{path}/identities.json", json.dumps({"users": users}).encode())
    asked = _events(spark, sf).select("event_id", F.concat(F.lit("token-"), (F.col("user_id") % 4).cast("string")).alias("token"))
    known = policy.authenticated(asked, policy.read_identities(spark, f"{path}/identities.json"))
    return known.select("event_id", F.col("user_id").alias("user"), "role")


# Audit logs


def _log(spark, sf) -> str:
    """A log that is written in two turns."""
    path = shared_folder(spark, "audit")
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("at"), F.to_json(F.struct("event_type", "props")).alias("record"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        sinks.append_chain(e.where(part), path, "user_id", ("event_id",), "at", "record")
    return path


_TWO = CHAIN.replace("ORDER BY event_id", "ORDER BY event_id % 2, event_id")


@query(f"WITH RECURSIVE {_TWO} SELECT user_id, seq AS sequence, previous_hash, entry_hash FROM h")
def audit_log_append(spark, sf):
    held = readers.audit_log(spark, _log(spark, sf), "user_id long")
    return held.select("user_id", "sequence", "previous_hash", "entry_hash")


@query("SELECT user_id, count(*) AS entries, true AS valid FROM events GROUP BY user_id")
def audit_log_verify(spark, sf):
    return audit.verify_chain(readers.audit_log(spark, _log(spark, sf), "user_id long"), "user_id").select("user_id", "entries", "valid")


@query(f"WITH RECURSIVE {_TWO}, b AS (SELECT * FROM h WHERE user_id = (SELECT min(user_id) FROM events)) SELECT seq AS sequence, entry_hash FROM b ORDER BY seq DESC LIMIT 10")
def audit_log_tail(spark, sf):
    held = readers.audit_log(spark, _log(spark, sf), "user_id long")
    first = table(spark, sf, "events").agg(F.min("user_id")).first()[0]
    return audit.tail(held.where(F.col("user_id") == first), 10).select("sequence", "entry_hash")


# Report bundles and streams


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def report_bundle(spark, sf):
    path = shared_folder(spark, "bundle")
    counts = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.bundle({"types": counts}, path)
    return spark.read.csv(f"{path}/types_csv", header=True, schema="event_type string, n long").join(spark.read.json(f"{path}/types_json").select("event_type"), "event_type")


@query("SELECT 'runtime' AS section, count(*) AS n FROM events UNION ALL SELECT 'skill', 0")
def report_read_back(spark, sf):
    """A summary written as a bundle and read back."""
    path = shared_folder(spark, "summary")
    rows = _events(spark, sf).select(F.col("event_type").alias("module"), F.lit("allow").alias("decision"), F.lit("low").alias("risk_level"), F.array(F.lit("a")).alias("matched_rules"), F.lit(True).alias("tool_guard_entered"))
    none = rows.where("false").withColumn("related_event_id", F.lit(None).cast("string")).drop("tool_guard_entered")
    issues = spark.createDataFrame([], "file string, issue string")
    sinks.bundle({"summary": report.summary(rows, none, issues)}, path)
    return readers.report_summaries(spark, path).where("measure IN ('total_events', 'total_scans')").select("section", "n")


def _stream(spark, sf, df: DataFrame, files: int = 3) -> DataFrame:
    """df as a stream of some files, one a batch."""
    path = shared_folder(spark, "stream")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, writer) -> None:
    q = writer.option("checkpointLocation", shared_folder(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()  # ends with what is there, or raises; a limit of its own would fail larger tables


@query("SELECT event_id FROM events")
def stream_history(spark, sf):
    """Batches that repeat ids leave each once in the history, and the last batch as `latest`."""
    path, e = shared_folder(spark, "history"), _events(spark, sf).select("event_id", "event_type")
    twice = e.unionByName(e.where("event_id % 5 = 0"))
    _run(spark, _stream(spark, sf, twice).writeStream.foreachBatch(sinks.record_writer(f"{path}/latest", f"{path}/all", table=f"{path}/table")))
    flat = spark.read.csv(f"{path}/table", header=True, schema="event_id long, event_type string")
    return spark.read.parquet(f"{path}/all").join(flat, "event_id").select("event_id")


@query("SELECT user_id, count(*) AS entries, true AS valid FROM events GROUP BY user_id")
def stream_audit_chain(spark, sf):
    path = f"{shared_folder(spark, 'chain')}/log"
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("at"), F.to_json(F.struct("event_type", "props")).alias("record"))
    _run(spark, _stream(spark, sf, e).writeStream.foreachBatch(sinks.chain_writer(path, "user_id", ("event_id",), "at", "record")))
    return audit.verify_chain(spark.read.schema(f"{_AUDIT}, user_id long").json(path), "user_id").select("user_id", "entries", "valid")


def _in_order(df: DataFrame, by: Column, slices: int, label: str, files: int = 4, cuts: list[int] | None = None) -> DataFrame:
    """df as a stream whose batches come in the order of a number: slices of it (up to each of the cuts), of some files each, written one after the other."""
    path, spark = shared_folder(df.sparkSession, label), df.sparkSession
    cuts = cuts or df.select(F.percentile_approx(by, [k / slices for k in range(1, slices)], 10_000)).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df.where((F.lit(True) if low is None else by > low) & (F.lit(True) if high is None else by <= high))
        part.repartition(files, F.rand(7)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(f"WITH RECURSIVE {CHAIN} SELECT user_id, seq AS sequence, previous_hash, entry_hash FROM h")
def stream_chain_state(spark, sf):
    """Chains of a stream whose heads are kept as state. The first 20 entries of each were there before it."""
    path, session_ = shared_folder(spark, "chain-out"), _with_rocksdb(spark)
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("at"), F.to_json(F.struct("event_type", "props")).alias("record"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    early, late = (placed.where(c).drop("_k") for c in ("_k <= 20", "_k > 20"))
    before = materialised(audit.build_chain(early, "user_id", ("event_id",), "at", "record"), "chain-before")
    with session_:
        _run(spark, chains.stream_chain(_in_order(late, F.col("event_id"), 3, "chain-in"), "user_id", "event_id", "at", "record", audit.heads(before, "user_id")).writeStream.format("parquet").option("path", path))
    return before.unionByName(spark.read.schema(f"user_id long, {_AUDIT}").parquet(path)).select("user_id", "sequence", "previous_hash", "entry_hash")


@contextlib.contextmanager
def _with_rocksdb(spark):
    """State of the streams started here lies in RocksDB; the session's own choice holds afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)


@query(f"SELECT approval_id, CASE WHEN status IN ('pending', 'approved') THEN 'expired' ELSE status END AS status, decided_by, refused FROM ({APPROVALS})")
def stream_approval_fold(spark, sf):
    """Approvals by event time, in batches that hold the steps in no order; at the end a step a day later moves the watermark, so that all that is open expires.

    A quarter of the approvals were created before the stream, and are its initial state."""
    path, rows = shared_folder(spark, "approvals-out"), _approval_events(spark, sf)
    whole = F.count_if(F.col("seq") == 0).over(Window.partitionBy("approval_id")) > 0
    before = whole & (F.col("approval_id").cast("long") % 4 == 0)
    placed = materialised(rows.withColumn("_before", before), "approval-rows")
    created = placed.where("_before AND seq = 0")
    snapshot = created.select("approval_id", F.lit("pending").alias("status"), F.col("actor_id").alias("requested_by"), "request_hash", F.lit(None).cast("string").alias("decided_by"), (F.col("at") + F.expr(f"INTERVAL {TTL_MINUTES} MINUTES")).alias("expires_at"))
    # Both halves of the approvals are there before the watermark moves, each step in one of three batches.
    steps = placed.where("NOT (_before AND seq = 0)").drop("_before")
    last = steps.limit(1).select(F.lit("tick").alias("approval_id"), F.lit(0).cast("long").alias("seq"), F.lit("tick").alias("action"), *(F.lit(None).cast("string").alias(c) for c in ("actor_id", "actor_role")), F.lit(False).alias("approve"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit("").alias("request_hash"))
    turn = F.pmod(F.xxhash64("approval_id", "seq"), F.lit(3))
    feed = steps.select(*last.columns, turn.alias("_turn")).unionByName(last.withColumn("_turn", F.lit(3).cast("long")))
    with _with_rocksdb(spark):
        stream = _in_order(feed, F.col("_turn"), 4, "approvals-in", cuts=[0, 1, 2])
        _run(spark, approvals_stream.stream_approvals(stream, "3 hours", snapshot).writeStream.format("parquet").option("path", path))
    done = spark.read.schema(approvals_stream.STEP).parquet(path).where("approval_id <> 'tick'")
    place = F.struct("at", F.when(F.col("action") == "expire", 0).when(F.col("action") == "create", 1).when(F.col("action") == "decide", 2).otherwise(3), F.col("status") == "consumed")
    return done.groupBy("approval_id").agg(F.max_by("status", place).alias("status"), F.max("decided_by").alias("decided_by"), F.count_if(~F.col("accepted")).alias("refused"))


@query(f"SELECT t.event_id, p.decision AS policy_decision, t.decision AS chain_decision, t.prior_events, true AS logged FROM ({TAINT}) t JOIN ({POLICY}) p USING (event_id)")
def stream_requests(spark, sf):
    """The continuous job over all requests in batches: each is judged once and has an audit entry in a chain that verifies."""
    path = shared_folder(spark, "requests-out")
    rows = _requests(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "session_id": F.col("session_id").cast("string"), "execute": F.lit(True)}).select(*requests.COLUMNS)
    tools = tuple(policy.Policy().tool_risk)
    with _with_rocksdb(spark):
        q = requests.start(_in_order(rows, F.unix_micros("ts"), 3, "requests-in"), path, tools, shared_folder(spark, "requests-state"), availableNow=True)
        q.awaitTermination()
    entries = requests.finished(spark, path, "audit", f"day string, {_AUDIT}")
    sound = audit.verify_chain(entries, "day").where("valid").select("day")
    logged = entries.join(sound, "day").select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), F.lit(True).alias("logged"))
    done = requests.finished(spark, path, "verdicts", requests.VERDICT)
    return done.join(logged, "event_id", "left").select("event_id", "policy_decision", "chain_decision", "prior_events", F.coalesce("logged", F.lit(False)).alias("logged"))


@query("SELECT k AS line FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events) WHERE event_id % 53 = 0 OR event_id % 59 = 0")
def broken_audit_lines(spark, sf):
    """Lines of one log that aren't entries, by number, from blocks of 64 KB that are read side by side."""
    path = shared_folder(spark, "lines")
    e = table(spark, sf, "events").orderBy("event_id").select("event_id", F.to_json(F.struct(F.col("event_id").alias("sequence"), F.lit("t").alias("timestamp"), F.col("props").alias("record"), F.lit("a").alias("previous_hash"), F.lit("b").alias("entry_hash"))).alias("j"))
    line = F.when(F.col("event_id") % 53 == 0, F.concat(F.lit("{"), "j")).when(F.col("event_id") % 59 == 0, '{"sequence":1}').otherwise(F.col("j"))
    e.select(line.alias("value")).coalesce(1).write.text(path)
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        return materialised(readers.broken_lines(spark, path).select("line"), "broken")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)


_AUDIT = "sequence long, timestamp string, record string, previous_hash string, entry_hash string"


@query(TAINT)
def stream_session_taint(spark, sf):
    """The state of sessions kept from batch to batch gives the rows that windows give."""
    path, rows = shared_folder(spark, "taint"), _requests(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "session_id": F.col("session_id").cast("string")})
    with _with_rocksdb(spark):
        stream = _in_order(rows, F.unix_micros("ts"), 4, "taint-in")
        _run(spark, sessions.stream_sessions(stream).writeStream.format("parquet").option("path", path))
    df = spark.read.parquet(path)
    return df.select("event_id", F.col("prior_class").cast("long").alias("prior_class"), "prior_credential", "prior_sensitive", F.col("prior_events").cast("long").alias("prior_events"), F.array_join("chain_rules", "|").alias("rules"), F.col("chain_decision").alias("decision"))


@query("SELECT event_id FROM events")
def stream_once(spark, sf):
    """Ids come twice: some in one batch, others again in the batch after, half an hour of event time later, within the watermark."""
    path, e = shared_folder(spark, "once"), table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    again = e.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    stream = _in_order(e.unionByName(e.where("event_id % 3 = 1")).unionByName(again), F.unix_micros("ts"), 3, "once-in")
    _run(spark, sessions.once(stream).writeStream.format("parquet").option("path", path))
    return spark.read.parquet(path).select("event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 0")
def session_owner_counts(spark, sf):
    """Rows of valid session ids by their owner."""
    e = _events(spark, sf).withColumn("session_id", F.concat(F.lit("SES-USER-"), F.lpad(F.col("user_id").cast("string"), 8, "0")))
    return e.where(session.valid_session_id(F.col("session_id"))).groupBy("user_id").agg(F.count("*").alias("n"))
