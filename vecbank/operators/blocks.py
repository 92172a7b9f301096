"""Bounded blocks: how rows become matrices without any task holding a whole group.

``map_sorted_groups`` streams sorted groups through an Arrow function. ``blocked_join`` lets every
left/right pair of a group meet in exactly one block of bounded size; a group with a third of all
rows simply becomes more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096

Kernel = Callable[[pa.Table, pa.Table], pa.RecordBatch | None]


def _open_rows(table: pa.Table, keys: list[str]) -> int:
    """Rows at the end of the table that belong to its last, possibly unfinished, group."""
    same = None
    for key in keys:
        column = table.column(key)
        equal = pc.equal(column, column[len(column) - 1])
        same = equal if same is None else pc.and_(same, equal)
    return pc.sum(same).as_py() or 0


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start offsets of the groups of a sorted table, with the row count appended."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for key in keys:
        codes = pc.dictionary_encode(table.column(key).combine_chunks())
        codes = codes.indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(change), n)


def map_sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pa.Table], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Call ``fn`` with tables of complete groups, each group sorted by ``order``.

    One shuffle on ``keys`` and a spilling sort; a task holds one Arrow batch and one open group,
    so the caller has to bound the groups. Keys must not be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = pa.Table.from_batches([batch])
            pending = part if pending is None else pa.concat_tables([pending, part])
            done = pending.num_rows - _open_rows(pending, keys)
            if done:
                yield from fn(pending.slice(0, done))
                pending = pending.slice(done)
        if pending is not None and pending.num_rows:
            yield from fn(pending)

    sorted_df = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_df.mapInArrow(run, schema)


def blocked_join(
    left: DataFrame,
    right: DataFrame,
    group: str,
    left_id: str,
    right_id: str,
    kernel: Kernel,
    schema: str,
    left_rows: int = BLOCK_ROWS,
    right_rows: int = BLOCK_ROWS,
    right_sizes: DataFrame | None = None,
) -> DataFrame:
    """Let all rows that agree on ``group`` meet, block against block.

    The group sizes decide into how many blocks either side is salted. A left row is copied once per
    right block of its group and the reverse, which is the least a complete comparison can ship.
    ``kernel(left, right)`` sees two bounded tables and returns reduced rows (a maximum, a top-k),
    never the pairs. Columns of the two sides are united by name. ``right_sizes`` (group, ``n``) saves
    counting a right side whose group sizes are known.
    """
    if right_sizes is None:
        right_sizes = right.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    left_sizes = left.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = left_sizes.select(group, F.ceil(F.col("n") / left_rows).cast("int").alias("_nl")).join(
        right_sizes.select(group, F.ceil(F.col("n") / right_rows).cast("int").alias("_nr")), group
    )
    salt_left = F.pmod(F.xxhash64(F.col(left_id)), F.col("_nl")).cast("int")
    salt_right = F.pmod(F.xxhash64(F.col(right_id)), F.col("_nr")).cast("int")
    lefts = (
        left.join(sizes, group)
        .withColumn("_lb", salt_left)
        .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)))
        .withColumn("_side", F.lit(1))
    )
    rights = (
        right.join(sizes, group)
        .withColumn("_rb", salt_right)
        .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)))
        .withColumn("_side", F.lit(0))
    )
    both = lefts.unionByName(rights, allowMissingColumns=True).drop("_nl", "_nr")
    keys = [group, "_lb", "_rb"]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = group_bounds(table, keys)
        sides = table.column("_side").to_numpy()
        for start, stop in zip(bounds[:-1], bounds[1:]):
            split = int(start + np.searchsorted(sides[start:stop], 1))
            if split in (start, stop):
                continue
            out = kernel(table.slice(split, stop - split), table.slice(start, split - start))
            if out is not None and out.num_rows:
                yield out

    return map_sorted_groups(both, keys, ["_side"], run, schema)
