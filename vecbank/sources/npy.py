"""``.npy`` scans and shards: dense vector files and fixed-width label files.

Rows have a fixed width, so a partition is a byte range: tasks seek to their rows and nobody reads a
whole file. A path may be one file or a folder of shards (read in name order).

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load("bank/base_features.npy")   # row_id long, vec array<float>
    spark.read.format("npy").load("bank/base_species.npy")    # row_id long, species string

With the option ``labels`` the vector scan reads the label file alongside, row range by row range, so the
positional join of the two needs no shuffle (row_id, species, vec).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vecbank.functions.vectors import list_matrix, matrix_list
from vecbank.operators.blocks import group_bounds, map_sorted_groups
from vecbank.settings import LABEL_CHARS
from vecbank.sources.files import resolve, write_atomically

VECTOR_SCHEMA = "row_id long, vec array<float>"
LABEL_SCHEMA = "row_id long, species string"
BANK_SCHEMA = "row_id long, species string, vec array<float>"
ROWS_PER_PARTITION = 65536
_HEADER_BYTES = 4096
_BATCH_ROWS = 8192


def _header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    fs, name = resolve(path)
    with fs.open_input_file(name) as f:
        head = io.BytesIO(f.read(_HEADER_BYTES))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(head)
    if fortran and len(shape) > 1:
        raise ValueError(f"{path}: column-major files are not supported")
    return shape, dtype, head.tell()


def _shards(path: str) -> list[str]:
    fs, name = resolve(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(name))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".npy")]


def dense_shape(path: str) -> tuple[int, int]:
    """(rows, width) of a vector file or folder of shards, from the headers alone."""
    shapes = [_header(s)[0] for s in _shards(path)]
    if any(len(shape) != 2 for shape in shapes) or len({shape[1] for shape in shapes}) > 1:
        raise ValueError(f"{path} is not one 2-D matrix: {shapes}")
    return sum(shape[0] for shape in shapes), shapes[0][1] if shapes else 0


def label_count(path: str) -> int:
    return sum(_header(s)[0][0] for s in _shards(path))


class RowRange(InputPartition):
    def __init__(self, path: str, labels: str | None, first_row: int, start: int, stop: int):
        self.path, self.labels, self.first_row, self.start, self.stop = path, labels, first_row, start, stop


def _rows(path: str, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows start..stop of one file in batches, reading only their bytes."""
    shape, dtype, offset = _header(path)
    width = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
    fs, name = resolve(path)
    with fs.open_input_file(name) as f:
        f.seek(offset + start * width)
        for a in range(start, stop, _BATCH_ROWS):
            n = min(_BATCH_ROWS, stop - a)
            yield np.frombuffer(f.read(n * width), dtype=dtype).reshape(n, *shape[1:])


def _column(rows: np.ndarray) -> pa.Array:
    if rows.dtype.kind == "U":
        return pa.array(rows.tolist(), pa.string())
    return matrix_list(rows.astype(np.float32), pa.float32())


class NpyReader(DataSourceReader):
    def __init__(self, path: str, labels: str | None, rows_per_partition: int):
        self.path, self.labels, self.rows = path, labels, rows_per_partition

    def partitions(self) -> list[RowRange]:
        shards = _shards(self.path)
        labels = _shards(self.labels) if self.labels else [None] * len(shards)
        counts = [_header(s)[0][0] for s in shards]
        if self.labels and counts != [_header(s)[0][0] for s in labels]:
            raise ValueError("labels and vectors differ in length")
        parts, first = [], 0
        for shard, label, n in zip(shards, labels, counts):
            parts += [RowRange(shard, label, first, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
            first += n
        return parts

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        p = partition
        at = p.first_row + p.start
        names = _rows(p.labels, p.start, p.stop) if p.labels else None
        for rows in _rows(p.path, p.start, p.stop):
            ids = pa.array(np.arange(at, at + len(rows), dtype=np.int64))
            at += len(rows)
            if names is not None:
                yield pa.RecordBatch.from_arrays([ids, _column(next(names)), _column(rows)], ["row_id", "species", "vec"])
            else:
                yield pa.RecordBatch.from_arrays([ids, _column(rows)], ["row_id", "species" if rows.dtype.kind == "U" else "vec"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        shards = _shards(self.options["path"])
        if not shards:
            raise ValueError(f"no .npy file in {self.options['path']}")
        shape, dtype, _ = _header(shards[0])
        if dtype.kind == "U" and len(shape) == 1:
            return LABEL_SCHEMA
        if dtype.kind == "f" and len(shape) == 2:
            return BANK_SCHEMA if self.options.get("labels") else VECTOR_SCHEMA
        raise ValueError(f"neither a 2-D float matrix nor a 1-D label list: {shape} {dtype}")

    def reader(self, schema) -> NpyReader:
        rows = int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION))
        return NpyReader(self.options["path"], self.options.get("labels"), rows)


def _npy_bytes(array: np.ndarray) -> list[bytes]:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
    return [head.getvalue(), np.ascontiguousarray(array).tobytes()]


def write_npy(bank: DataFrame, out: str, dtype: str = "fp16", rows_per_shard: int = 65536) -> int:
    """Write ``row_id, species, vec`` as shards ``out/base_features/*.npy`` and ``out/base_species/*.npy``.

    ``row_id`` has to run from 0 without gaps. Returns the number of rows written.
    """
    value_type = np.dtype(np.float16 if dtype == "fp16" else np.float32)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        bounds = group_bounds(table, ["shard"])
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = table.slice(int(a), int(b - a))
            name = f"part-{part.column('shard')[0].as_py():06d}.npy"
            vectors = list_matrix(part.column("vec"), np.float32).astype(value_type)
            names = part.column("species").to_pylist()
            labels = np.array(names, dtype=f"U{LABEL_CHARS}")
            if len(set(labels.tolist())) < len(set(names)):
                raise ValueError(f"labels that differ only beyond {LABEL_CHARS} characters cannot be told apart in this format")
            write_atomically(f"{out}/base_features/{name}", _npy_bytes(vectors), attempt)
            write_atomically(f"{out}/base_species/{name}", _npy_bytes(labels), attempt)
            yield pa.RecordBatch.from_arrays([pa.array([len(labels)], pa.int64())], ["rows"])

    sharded = bank.select(
        F.floor(F.col("row_id") / rows_per_shard).cast("long").alias("shard"), "row_id", "species",
        F.col("vec").cast("array<float>").alias("vec"),
    )
    written = map_sorted_groups(sharded, ["shard"], ["row_id"], run, "rows long")
    return written.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
