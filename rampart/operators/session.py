"""Session correlation: what earlier rows of a session make of this one. Batch form, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import external
from ..schemas import CLASSES, rank
from .scans import HOT_ROWS, Fold, scanned

# What a task chain takes for outbound, high-impact and reading; words of credentials and sensitive data.
OUTBOUND, LONG_CHAIN, READS = ("export", "create", "update"), ("export", "delete", "execute"), ("read", "search")
LONG_AFTER, KEPT = 7, 50
CREDENTIAL = r"(?iu)(api\s*key|token|cookie|密码|密钥|私钥|credential|secret)"
SENSITIVE = r"(?iu)(内部|敏感|机密|客户|员工|审批|身份证|手机号|数据库)"


def _class(value: Column, strict: bool) -> Column:
    """The rank of a class. An unknown one is the highest, or raises."""
    found = rank(F.lower(value), CLASSES)
    odd = F.raise_error(F.lit("unknown classification")).cast("int") if strict else F.lit(len(CLASSES) - 1)
    return F.when(found.isNull(), odd).otherwise(found)


def chain_decision(operation: Column, tool: Column, destination: Column, outside: Column, prior_class: Column, credential: Column, sensitive: Column, earlier: Column) -> tuple[Column, Column]:
    """Rules met and the decision, from the state before the row."""
    out = F.coalesce(operation.isin(*OUTBOUND) | (tool == "http_post"), F.lit(False))
    one, two = outside & out & (prior_class >= 1), outside & out & credential
    three = out & (F.coalesce(F.trim(destination), F.lit("")) == "") & sensitive & ~one & ~two
    four = (earlier >= LONG_AFTER) & operation.isin(*LONG_CHAIN) & ~one & ~two & ~three
    named = ((one, "task_chain_classified_read_then_external_write"), (two, "task_chain_credential_access_then_external_write"), (three, "task_chain_sensitive_access_then_unscoped_write"), (four, "long_high_impact_task_chain"))
    rules = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))
    return rules, F.when(one | two, "block").when(three | four, "review").otherwise("allow")


def session_verdicts(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), suffixes: tuple[str, ...] = (".gov.cn",), hot_rows: int = HOT_ROWS, strict: bool = False) -> DataFrame:
    """events (session_id, principal_id, input_text, tool_name, operation, classification, destination) with the state
    before each row, chain_rules and chain_decision. Only reads and searches raise the class. A row of another principal
    than the session's first is blocked and no part of the session; one of an unknown class is blocked and counts as of the
    highest. strict: both raise. A row is judged on what came before it, in the given order. A session of any number of rows
    is scanned by many tasks, once it has hot_rows."""
    op, text, cls = F.lower("operation"), F.coalesce(F.col("input_text"), F.lit("")), _class(F.col("classification"), strict)
    outside = external(F.col("destination"), F.array(*map(F.lit, suffixes)))
    owned = F.col("_owner").eqNullSafe(F.col("principal_id"))
    df = scanned(events, "session_id", order, [Fold("_owner", "first", F.col("principal_id"))], hot_rows)
    folds = [
        Fold("prior_class", "max", F.when(owned & op.isin(*READS), cls)), Fold("prior_credential", "max", owned & text.rlike(CREDENTIAL)),
        Fold("prior_sensitive", "max", owned & (text.rlike(SENSITIVE) | (cls >= 1))), Fold("prior_events", "count", F.when(owned, 1)),
    ]
    df = scanned(df, "session_id", order, folds, hot_rows).fillna(0, ["prior_class"]).fillna(False, ["prior_credential", "prior_sensitive"])
    rules, decision = chain_decision(op, F.col("tool_name"), F.col("destination"), outside, F.col("prior_class"), F.col("prior_credential"), F.col("prior_sensitive"), F.least("prior_events", F.lit(KEPT)))
    odd = rank(F.lower("classification"), CLASSES).isNull()
    wrong = F.raise_error(F.lit("session belongs to another principal")).cast("string") if strict else F.lit("block")
    decision = F.when(~owned, wrong).when(odd, "block").otherwise(decision)
    rules = F.when(~owned, F.array(F.lit("session_of_another_principal"))).when(odd, F.concat(F.array(F.lit("unknown_classification")), rules)).otherwise(rules)
    return df.withColumn("chain_rules", rules).withColumn("chain_decision", decision).drop("_owner")


def last_events(events: DataFrame, keep: int = KEPT, order: tuple[str, ...] = ("ts", "event_id"), by: str = "session_id") -> DataFrame:
    """The last rows of each session."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")


def daily_ids(events: DataFrame, kind: str = "EVT", at: str = "ts", order: tuple[str, ...] = ("ts", "event_id"), most: int | None = 999) -> DataFrame:
    """events with id `EVT-YYYYMMDD-NNN`, counted by day. most: beyond it the day raises (None: no limit).

    A day is numbered without gathering it: rows are counted by (day, minute) first and numbered within the minute.
    """
    day, part = F.date_format(at, "yyyyMMdd"), F.date_format(at, "HHmm")
    df = events.withColumn("_day", day).withColumn("_part", part)
    counts = df.groupBy("_day", "_part").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("_day").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    n = F.col("_ahead") + F.row_number().over(Window.partitionBy("_day", "_part").orderBy(*order))
    df = df.join(ahead, ["_day", "_part"]).withColumn("_no", n)
    if most is not None:
        df = df.withColumn("_no", F.when(F.col("_no") > most, F.raise_error(F.lit("too many ids in a day")).cast("long")).otherwise(F.col("_no")))
    return df.withColumn("daily_id", F.concat(F.lit(kind + "-"), "_day", F.lit("-"), F.when(F.col("_no") < 1000, F.lpad(F.col("_no").cast("string"), 3, "0")).otherwise(F.col("_no").cast("string")))).drop("_day", "_part", "_no", "_ahead")


def duplicates(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The second and later rows of each key. Null keys repeat nothing. Only rows of keys that occur twice are moved to be numbered."""
    twice = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    w = Window.partitionBy(key).orderBy(*order)
    return rows.join(twice, key, "left_semi").withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def session_ids(rows: DataFrame, name: str = "session_id") -> DataFrame:
    """rows with a random id of a session, `SES-` and 16 hexadecimal digits."""
    return rows.withColumn(name, F.concat(F.lit("SES-"), F.upper(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))))


def valid_session_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^SES-[A-Z0-9-]{8,64}$"), F.lit(False))
