"""Hash-chained audit entries: building a chain, going on with one, and finding its first break."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import canonical, masked, parsed
from ..sources.shared import materialised
from .scans import HOT_ROWS, Fold, scanned

START = "0" * 64


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def entry_hash(previous: Column, sequence: Column, timestamp: Column, record: Column) -> Column:
    """SHA-256 of the hash before and the canonical JSON of the entry. record: canonical JSON text."""
    payload = F.concat(F.lit('{"record":'), record, F.lit(',"sequence":'), sequence.cast("string"), F.lit(',"timestamp":'), _quoted(timestamp), F.lit("}"))
    return F.sha2(F.concat(previous, payload), 256)


def entered(text: str | None) -> str:
    """The record of an entry as it is kept. What isn't an object is on record too, as what it was."""
    record = parsed(text) if text is not None else None
    return canonical(masked(record if isinstance(record, dict) else {"invalid_record": text}))


def linked_entry(previous: str, sequence: int, stamp: str | None, text: str | None) -> tuple[str, str]:
    """The record of an entry as it is kept, and the entry's hash."""
    record = entered(text)
    payload = f'{{"record":{record},"sequence":{sequence},"timestamp":{canonical(stamp)}}}'
    return record, hashlib.sha256((previous + payload).encode()).hexdigest()


@F.pandas_udf(StructType([StructField("record", StringType()), StructField("stamp", StringType())]))
def _entered(stamps: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """The record of each entry as it is kept, and its timestamp as JSON: all of an entry that doesn't hang on the one before."""
    pairs = [tuple(None if pd.isna(x) else x for x in pair) for pair in zip(stamps, texts, strict=True)]
    return pd.DataFrame({"record": [entered(text) for _, text in pairs], "stamp": [canonical(stamp) for stamp, _ in pairs]}, dtype=object)


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chain, start sequence, start hash, timestamp, record and timestamp as they are hashed) in order, one hash carried at a time."""
    at = None
    for batch in batches:
        sequences, before, hashes = [], [], []
        chains, firsts, starts, _, records, stamps = (c.to_pylist() for c in batch.columns)
        for chain, first, start, record, stamp in zip(chains, firsts, starts, records, stamps, strict=True):
            if at is None or at[0] != (chain,):
                at = ((chain,), first, start)
            sequence, previous = at[1] + 1, at[2]
            own = hashlib.sha256(f'{previous}{{"record":{record},"sequence":{sequence},"timestamp":{stamp}}}'.encode()).hexdigest()
            at = (at[0], sequence, own)
            sequences.append(sequence)
            before.append(previous)
            hashes.append(own)
        columns = [batch.column(0), pa.array(sequences, pa.int64()), batch.column(3), batch.column(4), pa.array(before, pa.string()), pa.array(hashes, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "sequence", "timestamp", "record", "previous_hash", "entry_hash"])


def heads(entries: DataFrame, chain: str) -> DataFrame:
    """chain, and the sequence and hash of its last entry."""
    last = F.max_by(F.struct("sequence", "entry_hash"), "sequence")
    return entries.groupBy(chain).agg(last.alias("_l")).select(chain, F.col("_l.sequence").alias("last_sequence"), F.col("_l.entry_hash").alias("last_hash"))


def build_chain(rows: DataFrame, chain: str, order: tuple[str, ...], timestamp: str, record: str, after: DataFrame | None = None) -> DataFrame:
    """chain, sequence (from 1), timestamp, record (canonical, secrets masked), previous_hash and entry_hash.

    record: JSON text of an object; any other text is entered as {"invalid_record": text}. after: heads() of chains that go on. Records are
    parsed, masked and written side by side. A chain is then linked in order by one task, which holds one hash of it and does no more than
    hash; chains by day or partition are linked side by side. Order ties are broken by the order columns given.
    """
    if after is not None:
        rows = rows.join(after.select(F.col(chain).alias("_chain"), "last_sequence", "last_hash"), F.col(chain).eqNullSafe(F.col("_chain")), "left").drop("_chain")
    else:
        rows = rows.withColumns({"last_sequence": F.lit(0).cast("long"), "last_hash": F.lit(START)})
    start = (F.coalesce("last_sequence", F.lit(0)).cast("long").alias("_first"), F.coalesce("last_hash", F.lit(START)).alias("_start"))
    rows = rows.withColumn("_at", F.col(timestamp).cast("string")).withColumn("_e", _entered("_at", F.col(record)))
    held = rows.select(chain, *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order)), *start, "_at", F.col("_e.record").alias("_record"), F.col("_e.stamp").alias("_stamp"))
    held = held.repartition(chain).sortWithinPartitions(chain, *(f"_o{k}" for k in range(len(order)))).drop(*(f"_o{k}" for k in range(len(order))))
    kind = rows.schema[chain].dataType.simpleString()
    return held.mapInArrow(_linked, f"`{chain}` {kind}, sequence long, timestamp string, record string, previous_hash string, entry_hash string")


def _checked(entries: DataFrame, chain: str, hot_rows: int) -> DataFrame:
    """entries (with _start and _start_hash, which the chain goes on from) with `_bad`."""
    folds = [Fold("_place", "count"), Fold("_before", "last", F.col("entry_hash"))]
    df = scanned(entries, chain, ("sequence",), folds, hot_rows)
    own = entry_hash(F.col("previous_hash"), F.col("sequence"), F.col("timestamp"), F.col("record"))
    follows = F.when(F.col("_place") == 0, F.col("_start_hash")).otherwise(F.col("_before"))
    bad = (F.col("sequence") != F.col("_start") + F.col("_place") + 1) | (F.col("previous_hash") != follows) | (F.col("entry_hash") != own)
    return df.withColumn("_bad", F.coalesce(bad, F.lit(True)))


def verify_chain(entries: DataFrame, chain: str, after: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """chain, entries, valid and first_break (the least sequence that is out of place, doesn't follow or doesn't hash).

    A long chain is checked in ranges of its sequence, each task with the last hash before its own. after: checked() of an
    earlier run, in which case only entries beyond it are read, and counted.
    """
    if after is None:
        rows = entries.withColumns({"_start": F.lit(0).cast("long"), "_start_hash": F.lit(START)})
    else:
        from_ = after.select(F.col(chain).alias("_chain"), F.col("last_sequence").alias("_start"), F.col("last_hash").alias("_start_hash"))
        met = entries.join(from_, F.col(chain).eqNullSafe(F.col("_chain")), "left").drop("_chain").fillna(0, ["_start"]).fillna(START, ["_start_hash"])
        rows = met.where(F.col("sequence").isNull() | (F.col("sequence") > F.col("_start")))
    return _checked(rows, chain, hot_rows).groupBy(chain).agg(F.count("*").alias("entries"), F.min(F.when(F.col("_bad"), F.col("sequence"))).alias("first_break")).withColumn("valid", F.col("first_break").isNull())


#: Entries of a Merkle tree's leaf, and children of a node above.
LEAF, FANOUT = 1024, 1024


def merkle_leaves(entries: DataFrame, chain: str, size: int = LEAF) -> DataFrame:
    """chain, leaf (from 0), entries, last_sequence, last_hash and digest of each run of `size` sequence numbers. Leaves that are full don't change as a chain goes on."""
    leaf = F.floor((F.col("sequence") - 1) / size).alias("leaf")
    hashes = F.array_sort(F.collect_list(F.struct("sequence", "entry_hash")))
    held = entries.groupBy(chain, leaf).agg(F.count("*").alias("entries"), hashes.alias("_h"))
    last = F.element_at("_h", -1)
    digest = F.sha2(F.array_join(F.transform("_h", lambda x: x["entry_hash"]), ""), 256)
    return held.select(chain, "leaf", "entries", last["sequence"].alias("last_sequence"), last["entry_hash"].alias("last_hash"), digest.alias("digest"))


def merkle_roots(leaves: DataFrame, chain: str, fanout: int = FANOUT) -> DataFrame:
    """chain, entries, last_sequence, last_hash and root. Levels are combined until each chain has one node; a node alone stays as it is."""
    held = leaves.select(chain, F.col("leaf").alias("node"), "entries", "last_sequence", "last_hash", "digest")
    while held.groupBy(chain).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] not in (None, 1):
        up = held.groupBy(chain, F.floor(F.col("node") / fanout).alias("node")).agg(
            F.sum("entries").alias("entries"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("_d"), F.max("last_sequence").alias("last_sequence"), F.max_by("last_hash", "last_sequence").alias("last_hash")
        )
        joined = F.sha2(F.array_join(F.transform("_d", lambda x: x["digest"]), ""), 256)
        held = materialised(up.select(chain, "node", "entries", "last_sequence", "last_hash", F.when(F.size("_d") > 1, joined).otherwise(F.get("_d", F.lit(0))["digest"]).alias("digest")), "merkle")
    return held.select(chain, "entries", "last_sequence", "last_hash", F.col("digest").alias("root"))


def checked(entries: DataFrame, chain: str, size: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """merkle_roots() of the chains that verify: what a later run goes on from."""
    fine = verify_chain(entries, chain).where("valid").select(F.col(chain).alias("_chain"))
    roots = merkle_roots(merkle_leaves(entries, chain, size), chain, fanout)
    return roots.join(fine, F.col(chain).eqNullSafe(F.col("_chain"))).drop("_chain")


def tail(entries: DataFrame, n: int) -> DataFrame:
    return entries.orderBy(F.desc("sequence")).limit(n)
