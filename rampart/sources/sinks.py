"""Sinks: JSON, CSV, appends that don't repeat an id, report bundles, hash-chained logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.report import flattened
from ..schemas import AUDIT


def write_json(rows: DataFrame, path: str) -> None:
    """Whole or not at all: the committer moves files when the job is done."""
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flattened(rows.select(*(columns or rows.columns))).write.mode("overwrite").csv(path, header=True, escape='"')


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, key: str = "event_id", fmt: str = "parquet") -> DataFrame:
    """Append the rows whose key isn't there yet; of rows with one key, one. Returns them."""
    new = rows.dropDuplicates([key])
    if _exists(rows.sparkSession, path):
        held = rows.sparkSession.read.format(fmt).options(header=True).load(path).select(F.col(key).cast(rows.schema[key].dataType))
        new = new.join(held, key, "left_anti")
    new.write.mode("append").format(fmt).options(header=True).save(path)
    return new


def append_chain(rows: DataFrame, path: str, chain: str, order: tuple[str, ...], timestamp: str, record: str) -> None:
    """Entries as JSON lines, which name their chain. A chain that is there goes on from its last entry. One writer at a time.

    Chains share files, as a folder for each would make as many files as there are chains."""
    after = None
    if _exists(rows.sparkSession, path):
        held = rows.sparkSession.read.schema(f"{AUDIT}, `{chain}` {rows.schema[chain].dataType.simpleString()}").json(path)
        after = audit.heads(held, chain)
    audit.build_chain(rows, chain, order, timestamp, record, after).write.mode("append").json(path)


def chain_writer(path: str, chain: str, order: tuple[str, ...], timestamp: str, record: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's entries go on from those of the batches before. A batch that is run again is written over."""

    def write(batch: DataFrame, number: int) -> None:
        after, kind = None, batch.schema[chain].dataType.simpleString()
        if number and _exists(batch.sparkSession, path):
            held = batch.sparkSession.read.schema(f"{AUDIT}, `{chain}` {kind}, batch long").json(path)
            after = audit.heads(held.where(F.col("batch") < number), chain)
        audit.build_chain(batch, chain, order, timestamp, record, after).write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def bundle(parts: dict[str, DataFrame], folder: str) -> None:
    """A report: each part as a folder of JSON and of CSV."""
    for name, df in parts.items():
        write_json(df, f"{folder}/{name}_json")
        write_csv(df, f"{folder}/{name}_csv")


def record_writer(latest: str, history: str, key: str = "event_id", table: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last batch as `latest`, new ids appended to `history` and, as flat rows, to the CSV `table`."""

    def write(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            write_json(held, latest)
            append_new(held, history, key)
            if table is not None:
                append_new(flattened(held), table, key, "csv")
        finally:
            held.unpersist()

    return write
