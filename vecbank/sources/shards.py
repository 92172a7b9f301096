"""A stream over a folder of Parquet files in reader shards: every shard takes every n-th file and moves on at its own offset.

``spark.readStream.format("vecbank_shards")`` with the options ``path``, ``progress`` (a file that remembers how far the shards
were offered), ``shards`` and ``files_per_batch`` (files a shard may take in one micro-batch). A task reads the files of one shard.
Files are taken in the order of their names; new ones have to sort behind those that are there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from vecbank.sources.files import resolve, write_atomically

FORMAT = "vecbank_shards"
BATCH_ROWS = 4096


class Files(InputPartition):
    """Files of one shard, by their places in it."""

    def __init__(self, shard: int, first: int, end: int):
        self.shard, self.first, self.end = shard, first, end


class ShardReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.progress = options["path"], options["progress"]
        self.shards, self.at_once = int(options.get("shards", 4)), int(options.get("files_per_batch", 1))
        self.columns = columns
        self.offered = self._known()

    def _names(self) -> list[str]:
        fs, folder = resolve(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def _known(self) -> dict:
        """What an earlier run of the stream offered, as Spark does not tell the source where it stands.

        Spark's own log says where a batch starts. An offer that a crash kept from that log only makes the next batch larger.
        """
        fs, name = resolve(self.progress)
        if fs.get_file_info(name).is_file:
            with fs.open_input_file(name) as file:
                return json.loads(file.read())
        return self.initialOffset()

    def initialOffset(self) -> dict:
        return {str(s): 0 for s in range(self.shards)}

    def latestOffset(self) -> dict:
        """One step further for every shard that has files left."""
        n, before = len(self._names()), dict(self.offered)
        for s in range(self.shards):
            held = len(range(s, n, self.shards))
            self.offered[str(s)] = max(before[str(s)], min(before[str(s)] + self.at_once, held))
        if self.offered != before:
            write_atomically(self.progress, [json.dumps(self.offered).encode()], "offer")
        return dict(self.offered)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Files(s, start[str(s)], end[str(s)]) for s in range(self.shards) if start[str(s)] < end[str(s)]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = resolve(self.path)
        own = self._names()[partition.shard :: self.shards]
        for name in own[partition.first : partition.end]:
            with fs.open_input_file(name) as file:
                yield from pq.ParquetFile(file).iter_batches(BATCH_ROWS, columns=self.columns)


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options, schema.fieldNames())


def shard_stream(spark: SparkSession, path: str, schema: StructType | str, progress: str, shards: int = 4, files_per_batch: int = 1):
    """A stream of the rows of ``path``; ``progress`` belongs to the checkpoint of the query that reads it."""
    spark.dataSource.register(Shards)
    reader = spark.readStream.format(FORMAT).schema(schema)
    return reader.options(path=path, progress=progress, shards=shards, files_per_batch=files_per_batch).load()


def run_until_read(rows, out: str, checkpoint: str) -> int:
    """Store all that is there, one folder per micro-batch, and return the number of batches with rows."""
    query = (
        rows.writeStream.foreachBatch(lambda part, batch: part.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
        .option("checkpointLocation", checkpoint).start()
    )
    try:
        query.processAllAvailable()
        return sum(p.numInputRows > 0 for p in query.recentProgress)
    finally:
        query.stop()
