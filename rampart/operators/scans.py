"""Ordered scans within keys: what the rows of a key before each row add up to, without a key in one task.

Keys with few rows are one window. A key with more than HOT_ROWS rows and a HOT_SHARE of all (there are fewer than
HOT_SHARE of them) is scanned in two levels: its rows are dealt into ranges of its order and written, each range is summed up, the
sums of the ranges before are combined, and only then each row is worked out within its range. Sums are maxima, counts,
first and last values, all of which combine.

Defined cases: null keys are one key; rows are ordered by all of the order columns, which have to tell them apart, as in
any window; a fold without rows before is null (a count is 0); an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

#: A key is hot with more than so many rows and more than this share of all.
HOT_ROWS, HOT_SHARE = 100_000, 10_000


@dataclass(frozen=True)
class Fold:
    """What the rows before make of a value. how: max, count (of rows, or of those with a value), last, or first (which takes in the row itself)."""

    name: str
    how: str
    value: Column | None = None

    def alone(self, before, upto) -> Column:
        """Over the rows of a window."""
        if self.how == "max":
            return F.max(self.value).over(before)
        if self.how == "count":
            return F.count(F.lit(1) if self.value is None else self.value).over(before)
        held = F.struct(self.value.alias("v"))
        return (F.last(held) if self.how == "last" else F.first(held)).over(before if self.how == "last" else upto)

    def summed(self, order: Column) -> Column:
        """Of all rows of a group."""
        if self.how == "max":
            return F.max(self.value)
        if self.how == "count":
            return F.count(F.lit(1) if self.value is None else self.value)
        held = F.struct(self.value.alias("v"))
        return F.max_by(held, order) if self.how == "last" else F.min_by(held, order)

    def carried(self, column: Column, earlier) -> Column:
        """Of the sums of the ranges before."""
        if self.how == "max":
            return F.max(column).over(earlier)
        if self.how == "count":
            return F.coalesce(F.sum(column).over(earlier), F.lit(0))
        return (F.last(column) if self.how == "last" else F.first(column)).over(earlier)

    def both(self, ahead: Column, own: Column) -> Column:
        if self.how == "max":
            return F.greatest(ahead, own)
        if self.how == "count":
            return ahead + own
        return F.coalesce(own, ahead) if self.how == "last" else F.coalesce(ahead, own)

    def shown(self, column: Column) -> Column:
        return column["v"] if self.how in ("first", "last") else column


def _one_level(df: DataFrame, key: list[str], order: tuple[str, ...], folds: list[Fold]) -> DataFrame:
    upto = Window.partitionBy(*key).orderBy(*order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f.name: f.alone(before, upto) for f in folds})


def _two_levels(df: DataFrame, key: str, order: tuple[str, ...], folds: list[Fold], ranges: int | None) -> DataFrame:
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(df.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    at = F.struct(*order)
    # A range holds the end of one key, whole keys, and the start of another: there are as many sums as ranges and hot keys at most.
    sums = dealt.groupBy(key, "_range").agg(*(f.summed(at).alias(f"_s_{f.name}") for f in folds))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), *(f.carried(F.col(f"_s_{f.name}"), earlier).alias(f"_a_{f.name}") for f in folds))
    rows = _one_level(dealt, [key, "_range"], order, folds)
    rows = rows.join(F.broadcast(ahead), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return rows.withColumns({f.name: f.both(F.col(f"_a_{f.name}"), F.col(f.name)) for f in folds}).drop("_range", "_key", "_at", *(f"_a_{f.name}" for f in folds))


def scanned(df: DataFrame, key: str, order: tuple[str, ...], folds: list[Fold], hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """df with a column for each fold, of the rows of the same key before each row. ranges: into how many hot rows are dealt."""
    counts = materialised(df.groupBy(key).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where((F.col("_n") > hot_rows) & (F.col("_n") * HOT_SHARE > total)).select(F.col(key).alias("_hot"))
    if not hot.limit(1).count():
        return _shown(_one_level(df, [key], order, folds), folds)
    # Fewer than HOT_SHARE keys.
    same = F.col(key).eqNullSafe(F.col("_hot"))
    few = _one_level(df.join(F.broadcast(hot), same, "left_anti"), [key], order, folds)
    many = _two_levels(df.join(F.broadcast(hot), same, "left_semi"), key, order, folds, ranges)
    return _shown(few.unionByName(many), folds)


def _shown(df: DataFrame, folds: list[Fold]) -> DataFrame:
    return df.withColumns({f.name: f.shown(F.col(f.name)) for f in folds if f.how in ("first", "last")})
