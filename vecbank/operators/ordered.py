"""Running totals and row numbers over an order, without one task seeing a whole group.

A window ``partitionBy(label)`` puts a hot label into one task, a window without keys puts everything
there. Here rows are range-partitioned by (keys, order) and stored; every range is scanned on its own
and receives the totals of the ranges before it. A hot label just spans more ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from vecbank.session import materialize

RANGE = "_range"


class OrderedRanges:
    """Rows laid out in stored ranges along (keys, order)."""

    def __init__(self, df: DataFrame, order: list[str], keys: list[str] | None = None):
        self.keys = keys or []
        self.order = order
        placed = df.repartitionByRange(*self.keys, *order).withColumn(RANGE, F.spark_partition_id())
        # Stored, because the range bounds come from a sample and must not change between scans.
        self.rows = materialize(placed, "ranges")

    def in_range(self) -> WindowSpec:
        """A window over one range of one key."""
        return Window.partitionBy(RANGE, *self.keys).orderBy(*self.order)

    def with_earlier(self, rows: DataFrame, **totals: tuple[Column, Callable]) -> DataFrame:
        """Add, per row, what the earlier ranges of its key amount to.

        ``totals`` maps a column name to (aggregate over one range, function that combines ranges);
        the column is null in the first range of a key.
        """
        per_range = rows.groupBy(RANGE, *self.keys).agg(*[agg.alias(name) for name, (agg, _) in totals.items()])
        # One row per (key, range): this window is small even for a hot key.
        before = Window.partitionBy(*self.keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_range.select(
            RANGE, *self.keys, *[combine(name).over(before).alias(name) for name, (_, combine) in totals.items()]
        )
        # Null-safe: a missing key is a key of its own.
        theirs = {k: f"_k{i}" for i, k in enumerate([RANGE, *self.keys])}
        offsets = offsets.withColumnsRenamed(theirs)
        same = [rows[k].eqNullSafe(offsets[own]) for k, own in theirs.items()]
        return rows.join(offsets, reduce(and_, same)).drop(*theirs.values())


def running_totals(
    df: DataFrame, order: list[str], keys: list[str] | None = None, **values: Column
) -> DataFrame:
    """Add inclusive running sums of ``values`` along ``order`` within ``keys``."""
    ranges = OrderedRanges(df.withColumns({f"_v_{n}": v.cast("long") for n, v in values.items()}), order, keys)
    rows = ranges.with_earlier(ranges.rows, **{f"_o_{n}": (F.sum(f"_v_{n}"), F.sum) for n in values})
    upto = ranges.in_range().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {n: F.sum(f"_v_{n}").over(upto) + F.coalesce(f"_o_{n}", F.lit(0)) for n in values}
    )
    return rows.drop(RANGE, *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def numbered(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "n") -> DataFrame:
    """Row number from 1 along ``order`` within ``keys`` (``order`` must be total)."""
    return running_totals(df, order, keys, **{name: F.lit(1)})


def chunked(df: DataFrame, order: list[str], size: int, keys: list[str] | None = None) -> DataFrame:
    """Add ``chunk`` (from 0) and ``slot`` (from 0): consecutive groups of ``size`` rows."""
    rows = numbered(df, order, keys, "_n")
    return rows.withColumns(
        {
            "chunk": F.floor((F.col("_n") - 1) / size).cast("long"),
            "slot": ((F.col("_n") - 1) % size).cast("long"),
        }
    ).drop("_n")


def stride_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows spread evenly over the order (every step-th row from the first on)."""
    step = max(1, df.count() // limit)
    rows = numbered(df, order, name="_n")
    return rows.filter(((F.col("_n") - 1) % step == 0) & (F.col("_n") <= step * limit)).drop("_n")


def previous_value(df: DataFrame, order: list[str], keys: list[str], value: str, name: str) -> DataFrame:
    """Add ``value`` of the row before, within ``keys`` (a lag that tolerates hot keys)."""
    ranges = OrderedRanges(df, order, keys)
    at = F.struct(*order)
    rows = ranges.with_earlier(
        ranges.rows, _earlier=(F.max_by(F.struct(F.col(value).alias("v")), at), lambda c: F.last(c, ignorenulls=True))
    )
    lagged = F.lag(F.struct(F.col(value).alias("v"))).over(ranges.in_range())
    return rows.withColumn(name, F.coalesce(lagged, F.col("_earlier"))["v"]).drop(RANGE, "_earlier")
