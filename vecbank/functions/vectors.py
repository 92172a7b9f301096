"""Vector expressions: norms, dot products, normalisation, checks and codecs.

The native expressions suit row-wise checks. Anything that multiplies many vectors goes through
``operators.blocks`` / ``operators.knn``, which turn rows into matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecbank.settings import MIN_NORM


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so it is computed once per row.

    Written directly into an inner lambda, Catalyst would put the whole expression there and run it
    again for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def l2_normalize(vec: Column, floor: float = 0.0) -> Column:
    """``vec / norm``; with ``floor`` a shorter norm counts as 1, as when publishing a bank.

    Without a floor a zero vector becomes a vector of nulls instead of failing the job.
    """

    def divide(v: Column) -> Column:
        length = norm(v)
        safe = F.when(length < floor, F.lit(1.0)).otherwise(length) if floor else F.nullif(length, F.lit(0.0))
        return let(safe, lambda n: F.transform(v, lambda x: x / n))

    return let(as_double(vec), divide)


def is_finite(vec: Column) -> Column:
    """No NaN and no infinity. Spark orders NaN above every number, so test before comparing."""
    return F.forall(as_double(vec), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def has_dim(vec: Column, dim: int) -> Column:
    return F.coalesce(F.size(vec) == dim, F.lit(False))


def is_usable(vec: Column, dim: int) -> Column:
    """Right width, finite and not (almost) zero: the rows a bank may hold."""
    return F.coalesce(has_dim(vec, dim) & is_finite(vec) & (norm(vec) >= MIN_NORM), F.lit(False))


def list_matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """An Arrow column of equally long vectors (lists, or packed fp32 bytes) as an (n, dim) matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if n == 0:
        return np.zeros((0, 0), dtype=dtype)
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
        flat = np.frombuffer(column.buffers()[2], dtype="<f4", count=(offsets[-1] - offsets[0]) // 4, offset=offsets[0])
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % n:
        raise ValueError("vectors of different widths in one column")
    return flat.reshape(n, -1).astype(dtype, copy=False)


def matrix_list(matrix: np.ndarray, value_type: pa.DataType) -> pa.Array:
    """The inverse of :func:`list_matrix`."""
    n, dim = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1), type=value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), values)


def pack_list(vec: pa.Array) -> pa.Array:
    """An Arrow list column as fp32 bytes; without nulls in it, the values are moved as one buffer."""
    values = vec.flatten()
    if vec.null_count or values.null_count:
        return pa.array([None if v is None else np.array(v, dtype="<f4").tobytes() for v in vec.to_pylist()], pa.binary())
    flat = values.to_numpy(zero_copy_only=False).astype("<f4")
    lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(vec), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


@F.arrow_udf(T.BinaryType())
def to_bytes(vec: pa.Array) -> pa.Array:
    """array<float> -> little-endian fp32 bytes. Use it on stored columns; see ``operators.bank.packed``."""
    return pack_list(vec)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_bytes(raw: pa.Array) -> pa.Array:
    """fp32 bytes -> array<float>; null when the length is not a multiple of four."""
    raw = raw.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset) if len(raw) else np.zeros(1, np.int32)
    sizes = np.diff(offsets)
    good = raw.is_valid().to_numpy(zero_copy_only=False) & (sizes % 4 == 0)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    data = data[offsets[0] : offsets[-1]]
    if not good.all():
        data = data[np.repeat(good, sizes)]
    ends = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0)) // 4]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(data.view("<f4")), mask=pa.array(~good))


def to_base64(vec: Column) -> Column:
    return F.base64(to_bytes(vec))


def from_base64(text: Column) -> Column:
    """Text that is not base64 gives null instead of failing the scan."""
    return from_bytes(F.try_to_binary(text, F.lit("base64")))


def to_json_text(vec: Column) -> Column:
    return F.to_json(vec)


def from_json_text(text: Column) -> Column:
    """JSON array of numbers -> array<float>; broken text or a non-number gives null."""
    parsed = F.from_json(text, T.ArrayType(T.DoubleType()))
    ok = F.coalesce(F.size(parsed) > 0, F.lit(False)) & F.coalesce(F.forall(parsed, lambda x: x.isNotNull()), F.lit(False))
    return F.when(ok, parsed.cast("array<float>"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def half_precision(vec: pa.Array) -> pa.Array:
    """Round every value to fp16 and widen it again (what an fp16 bank file does to a vector)."""
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    lengths = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat, type=pa.float32()), mask=vec.is_null()
    )
