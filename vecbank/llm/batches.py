"""Small helpers for Arrow batches inside tasks, and what a Python worker keeps between them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 21

_memories: dict[str, dict] = {}


def memory(kind: str) -> dict:
    """What this Python worker keeps from task to task for one kind of work.

    A worker serves one stage after another. What it kept for another kind goes when it is asked for this one, so that
    the memories of all stages of a pipeline do not add up.
    """
    if kind not in _memories:
        _memories.clear()
    return _memories.setdefault(kind, {})


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def pieces(batches: Iterable[pa.RecordBatch], weigh: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose ``weigh`` column (binary) holds about ``limit`` bytes; a longer row stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(weigh))
        start = held = 0
        for row, value in enumerate(column):
            size = value.as_buffer().size if value.is_valid else 0
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def record(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    """A batch of ``schema`` from one list or array per column."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v := values[f.name], pa.Array) else pa.array(v, f.type) for f in schema], schema=schema
    )


def flushed(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int], limit: int = 2 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (tuples) as batches of about ``limit`` bytes, counted by ``weigh``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + weigh(row)
        if size >= limit:
            yield record(schema, dict(zip(schema.names, zip(*held), strict=True)))
            held, size = [], 0
    if held:
        yield record(schema, dict(zip(schema.names, zip(*held), strict=True)))
