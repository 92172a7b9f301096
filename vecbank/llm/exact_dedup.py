"""Exact dedup by Grace hash deduplication.

Copies first meet where they are read: each task keeps a bounded open-addressing table and passes on one record
per content it holds, so a text shared by a third of all rows crosses the shuffle once per task and table. The
records are dealt out by digest. A receiving task adds them to a table; when the table is full, its records and
the rest go to spill files by further bits of the digest, and each file is treated the same way, until it fits.
Tables compare complete contents, not digests alone.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, flushed, memory, text_bytes

MAP_BYTES = 24 << 20
TABLE_BYTES = 48 << 20
FAN_OUT = 16
RECORD = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
GROUP = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def digest_of(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def larger(a: int | None, b: int | None) -> int | None:
    """The larger id; a missing id loses."""
    return b if a is None else a if b is None else max(a, b)


class ContentTable:
    """Open addressing with linear probing; a slot holds the index of an entry [digest, content, keep_id, group_size]."""

    def __init__(self, bits: int = 10):
        self.slots = [-1] * (1 << bits)
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == digest and entry[1] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, keep_id: int | None, group_size: int) -> None:
        at = self._slot(digest, content)
        if (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            entry[2], entry[3] = larger(entry[2], keep_id), entry[3] + group_size
            return
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, keep_id, group_size])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, entry in enumerate(self.entries):
                self.slots[self._slot(entry[0], entry[1])] = i


class Spill:
    """Records on local disk, one file per value of four bits of the digest."""

    def __init__(self, folder: str, depth: int):
        self.depth = depth
        self.paths = [os.path.join(folder, f"{depth}-{i}") for i in range(FAN_OUT)]
        self.files = [open(p, "wb") for p in self.paths]  # noqa: SIM115

    def write(self, entry: Iterable) -> None:
        entry = tuple(entry)
        byte = entry[0][-1 - self.depth // 2]
        pickle.dump(entry, self.files[(byte >> 4) if self.depth % 2 else (byte & 15)], protocol=5)

    def read(self) -> Iterator[Iterator[tuple]]:
        for file in self.files:
            file.close()
        for path in self.paths:
            yield self._records(path)
            os.unlink(path)

    @staticmethod
    def _records(path: str) -> Iterator[tuple]:
        with open(path, "rb") as file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return


def merged(records: Iterable[tuple], folder: str, depth: int = 0, limit: int = TABLE_BYTES) -> Iterator[list]:
    """One entry per distinct content of ``records``; at most about ``limit`` bytes are in memory."""
    table, spill = ContentTable(), None
    for entry in records:
        if spill:
            spill.write(entry)
            continue
        table.add(*entry)
        if table.bytes > limit and len(table.entries) > 1 and depth < 16:
            os.makedirs(inner := os.path.join(folder, str(depth)), exist_ok=True)
            spill = Spill(inner, depth)
            for kept in table.entries:
                spill.write(kept)
            table = None
    if not spill:
        yield from table.entries
        return
    for bucket in spill.read():
        yield from merged(bucket, folder, depth + 1, limit)


def local_records(batches: Iterable[pa.RecordBatch], limit: int = MAP_BYTES) -> Iterator[pa.RecordBatch]:
    """Input: ``doc_id, text`` (binary). One record per distinct content of each bounded table."""
    memory("contents")  # tables go with their task

    def rows() -> Iterator[list]:
        table = ContentTable()
        for batch in batches:
            for doc_id, content in zip(*columns(batch, "doc_id", "text"), strict=True):
                table.add(digest_of(content), content, doc_id, 1)
                if table.bytes > limit:
                    yield from table.entries
                    table = ContentTable()
        yield from table.entries

    yield from flushed(rows(), RECORD, lambda r: len(r[1]))


def merged_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*columns(batch, *RECORD.names), strict=True)

    def rows(folder: str) -> Iterator[tuple]:
        for digest, _, keep_id, size in merged(records(), folder):
            yield digest.hex(), keep_id, size

    with tempfile.TemporaryDirectory() as folder:
        yield from flushed(rows(folder), GROUP, lambda r: 64)


def groups(docs: DataFrame) -> DataFrame:
    """``text_sha256, keep_id, group_size``: one row per distinct text of ``docs`` (``doc_id``, ``text``)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = docs.select("doc_id", text_bytes()).mapInArrow(local_records, "digest binary, content binary, keep_id long, group_size long")
    return records.repartition(n, "digest").mapInArrow(merged_groups, "text_sha256 string, keep_id long, group_size long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null is the empty text, and all empty texts are one group. The largest doc_id
    of a group stays. A null doc_id counts but stays only if the group has no other. Rows that repeat a doc_id with
    the same text are the same document: all carry ``kept``. Further columns of ``docs`` are not looked at.
    An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.sha2(text_bytes(), 256).alias("text_sha256"))
    found = rows.join(groups(docs), "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Exactly one row per distinct text of ``docs``, with its columns unchanged: the row of the largest doc_id.

    Among rows that repeat that doc_id (or, if the text has no other, the missing one) the first by the JSON of their
    columns stays. Repeats are numbered before the join, so Spark's group limit drops them in the tasks that read them.
    """
    keys = ["__sha", "__id", "__none"]
    key_columns = lambda doc_id: (F.coalesce(doc_id, F.lit(0).cast("long")).alias("__id"), F.isnull(doc_id).alias("__none"))
    kept = groups(docs).select(F.col("text_sha256").alias("__sha"), *key_columns(F.col("keep_id")))
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    rows = docs.select("*", F.sha2(text_bytes(), 256).alias("__sha"), *key_columns(F.col("doc_id").cast("long")), others.alias("__others"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__others"))
    rows = rows.withColumn("__place", place).filter("__place = 1")
    return rows.join(kept, keys, "left_semi").select(*docs.columns)
