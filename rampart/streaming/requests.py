"""The continuous job: requests of a stream through input gate, policy, session state and status, into several sinks, each batch once.

Session state is kept by Spark. What follows is worked out by batch, and written to folders named for the batch, which a
batch that is run again writes over: verdicts, audit entries, and the last entry of each audit chain, from which the next
batch goes on without reading the log. A line of the ledger comes last. What is below a folder without that line is of a
batch that will be run again, so readers take the batches of the ledger (`finished`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, pipeline, policy, session
from ..operators.prompt import prompt_verdicts
from ..schemas import AUDIT
from .sessions import stream_sessions

REQUEST = (
    "event_id long, ts timestamp, session_id string, principal_id string, role string, tool_name string, operation string, classification string, "
    "environment string, destination string, input_text string, execute boolean"
)
COLUMNS = tuple(c.split()[0] for c in REQUEST.split(", "))
VERDICT = "event_id long, session_id string, day string, prompt_decision string, policy_decision string, chain_decision string, chain_rules array<string>, prior_events long, final_decision string, status string, execution_status string, risk_level string"
HEAD = "day string, last_sequence long, last_hash string"


def judged(rows: DataFrame, registered: tuple[str, ...]) -> DataFrame:
    """Verdicts of requests (REQUEST) that have chain_rules, chain_decision and prior_events."""
    df = prompt_verdicts(rows, "input_text", full=True).withColumn("prompt_decision", F.col("decision")).drop("decision", "risk_level", "score", "matches", "views", "hard_block", "primary_type")
    none = F.lit(None).cast("string")
    df = policy.policy_verdicts(df).withColumns({"source_decision": none, "skill_decision": none, "tool_decision": none, "day": F.date_format("ts", "yyyyMMdd")})
    df = pipeline.runtime_status(pipeline.gated(df), registered)
    return df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in VERDICT.split(", ")))


def judged_table(requests: DataFrame, registered: tuple[str, ...]) -> DataFrame:
    """The same of a table, for what a stream's verdicts are held against."""
    return judged(session.session_verdicts(requests), registered)


def batch_writer(path: str, registered: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.from_json("payload", REQUEST).alias("_r"), "chain_rules", "chain_decision", F.col("prior_events").cast("long").alias("prior_events")).select("_r.*", "chain_rules", "chain_decision", "prior_events")
        judged(rows, registered).write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        verdicts = spark.read.schema(VERDICT).parquet(f"{path}/verdicts/batch={number}")
        before = spark.read.schema(HEAD).parquet(f"{path}/heads/batch={number - 1}") if number else spark.createDataFrame([], HEAD)
        entries = verdicts.select("day", "event_id", F.col("event_id").cast("string").alias("at"), F.to_json(F.struct("event_id", "final_decision", "status")).alias("record"))
        audit.build_chain(entries, "day", ("event_id",), "at", "record", before).write.mode("overwrite").parquet(f"{path}/audit/batch={number}")
        new = audit.heads(spark.read.schema(f"day string, {AUDIT}").parquet(f"{path}/audit/batch={number}"), "day")
        held = before.join(new, "day", "left_anti").unionByName(new)
        held.write.mode("overwrite").parquet(f"{path}/heads/batch={number}")
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return write


def finished(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """Rows of a sink in batches that the ledger holds."""
    ledger = spark.read.schema("number long").parquet(f"{path}/ledger").select("number")
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{part}")
    return rows.join(ledger, rows["batch"] == ledger["number"], "left_semi").drop("batch")


def start(requests: DataFrame, path: str, registered: tuple[str, ...], checkpoint: str, **trigger):
    """Starts the job over a stream of REQUEST rows. trigger: as of DataStreamWriter.trigger. Needs the RocksDB state store."""
    kept = stream_sessions(requests, carry=COLUMNS)
    return kept.writeStream.foreachBatch(batch_writer(path, registered)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
