"""Hash chains of a stream: each chain's last entry is kept as state, so a batch's work doesn't grow with the log."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.audit import START, linked_entry
from .parts import named, part

ENTRY = "sequence long, timestamp string, record string, previous_hash string, entry_hash string"


class ChainHead(StatefulProcessor):
    """Sequence and hash of each chain's last entry, in the map of the chain's part. Entries of a batch follow in the order of `place`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getMapState("head", StructType([StructField("chain", StringType())]), StructType([StructField("sequence", LongType()), StructField("hash", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [part for part in rows if len(part)]
        if not held:  # chains of the initial state without rows of their own
            return
        out, heads = [], {}
        for r in pd.concat(held).sort_values("place").itertuples(index=False):
            chain = None if pd.isna(r.chain) else r.chain
            if chain not in heads:
                kept = self.head.getValue(named(chain))
                heads[chain] = (0, START) if kept is None else tuple(kept)
            sequence, previous = heads[chain]
            record, own = linked_entry(previous, sequence + 1, r.stamp, r.text)
            out.append((chain, sequence + 1, r.stamp, record, previous, own))
            heads[chain] = (sequence + 1, own)
        for chain, head in heads.items():
            self.head.updateValue(named(chain), head)
        yield pd.DataFrame(out, columns=["chain", *(c.split()[0] for c in ENTRY.split(", "))])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Chains go on from entries that were there before the stream: audit.heads()."""
        for r in initialState.itertuples(index=False):
            self.head.updateValue(named(None if pd.isna(r.chain) else r.chain), (int(r.last_sequence), str(r.last_hash)))

    def close(self) -> None:
        pass


def stream_chain(rows: DataFrame, chain: str, order: str, timestamp: str, record: str, after: DataFrame | None = None) -> DataFrame:
    """Entries of a stream's rows, as audit.build_chain() makes them of a table. Rows of a batch are linked in order, batches as they come.

    after: audit.heads() of a log that the chains go on from, read once, when the stream first starts. A restart goes on
    from the state. Needs the RocksDB state store.
    """
    name = F.col(chain).cast("string").alias("chain")
    held = rows.select(part(chain), name, F.col(order).alias("place"), F.col(timestamp).cast("string").alias("stamp"), F.col(record).alias("text"))
    start = after.select(part(chain), name, "last_sequence", "last_hash").groupBy("part") if after is not None else None
    linked = held.groupBy("part").transformWithStateInPandas(ChainHead(), f"chain string, {ENTRY}", "Append", "None", initialState=start)
    return linked.select(F.col("chain").cast(rows.schema[chain].dataType).alias(chain), *(c.split()[0] for c in ENTRY.split(", ")))
