"""Streams that run batch operators: identification, and teaching into a store.

Each micro-batch runs the batch operator and writes its own folder, named by the batch id: a replayed
batch replaces its folder, so results are exactly-once. Streams with state of their own are in ``keyed.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecbank.operators.quotas import collection_progress
from vecbank.plans.identify import identify
from vecbank.plans.teach import teach
from vecbank.session import scratch_path
from vecbank.settings import MAX_PER_LABEL
from vecbank.sources.store import BankStore


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None, glob: str | None = None):
    """A stream over the Parquet files of a folder, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process everything that is there, then stop; the checkpoint remembers what was done.

    A batch is stored and handed over in the caller's session: the session of a stream runs without
    adaptive execution, which the joins of the batch operators want for skewed keys.
    """
    spark = stream.sparkSession

    def stored_batch(rows: DataFrame, batch: int) -> None:
        path = scratch_path(spark, f"batch-{batch}")
        rows.write.parquet(path)
        handle(spark.read.schema(rows.schema).parquet(path), batch)

    query = (
        stream.writeStream.foreachBatch(stored_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def observed_counts(results: DataFrame, out: str, checkpoint: str) -> dict[str, int]:
    """Store a stream of results carrying ``ok`` and return ``predictions, unreadable`` as Spark observed them on the way.

    The counts come with the progress of every micro-batch, so nothing is read again to know them.
    """
    watched = results.observe("served", F.count_if("ok").alias("predictions"), F.count_if(~F.col("ok")).alias("unreadable"))
    query = (
        watched.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = [p.observedMetrics["served"] for p in query.recentProgress if "served" in p.observedMetrics]
    return {name: sum(r[name] for r in rows) for name in ("predictions", "unreadable")}


def identify_stream(queries: DataFrame, bank: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Identify a stream of ``query_id, vec`` against one pinned bank."""

    def handle(rows: DataFrame, batch: int) -> None:
        identify(rows, bank, **options).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return run_available(queries, handle, checkpoint)


def teach_stream(store: BankStore, requests: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Teach a stream of ``seq, name, vec, allow_new``; every batch sees what earlier ones learned.

    The checkpoint names the stream, so several streams can teach one bank, one after the other.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        if store.is_committed(checkpoint, batch):
            return  # learned before a crash; its results were written first
        teach(store, rows, batch, checkpoint, out=f"{out}/batch={batch}", **options)

    return run_available(requests, handle, checkpoint)


def stream_output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def finish_curation(spark: SparkSession, out: str, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """Write the completion marker of a curation run next to its output and return it.

    ``collected, target_total, labels, complete, completed_at``. A run that was cut off has no marker;
    starting it again continues from its checkpoint.
    """
    progress = collection_progress(stream_output(spark, out), labels, max_per_label)
    marked = progress.withColumn("completed_at", F.unix_timestamp())
    marked.coalesce(1).write.mode("overwrite").parquet(_marker(out))
    return spark.read.parquet(_marker(out))


def _marker(out: str) -> str:
    return f"{out.rstrip('/')}-complete"


def is_finished(spark: SparkSession, out: str) -> bool:
    try:
        return not spark.read.parquet(_marker(out)).isEmpty()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
