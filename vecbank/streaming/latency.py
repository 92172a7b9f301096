"""Rolling latency samples as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vecbank.operators.serving import latency_percentiles
from vecbank.settings import LATENCY_WINDOW
from vecbank.streaming.jobs import run_available
from vecbank.streaming.keyed import state_settings

SALTS = 16
_SAMPLES = "kind string, salt int, seq long, ms double"


class LatestSamples(StatefulProcessor):
    """Keeps the ``window`` latest samples of its key and emits them after every batch."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "seq long, ms double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.samples.get()), columns=["seq", "ms"]).astype({"seq": "int64", "ms": "float64"})
        for part in rows:  # trimmed part by part: never more than one batch above the window
            held = pd.concat([held, part[["seq", "ms"]]]).nlargest(self.window, "seq")
        self.samples.put([(int(s), float(m)) for s, m in zip(held["seq"], held["ms"])])
        yield held.assign(kind=key[0], salt=int(key[1]))[["kind", "salt", "seq", "ms"]]

    def close(self) -> None:
        pass


def rolling_latency(
    samples: DataFrame, out: str, checkpoint: str, window: int = LATENCY_WINDOW, salts: int = SALTS
) -> DataFrame:
    """``kind, n, p50, p95`` over the latest samples of a stream of ``kind, seq, ms``.

    Every kind is spread over ``salts`` state keys, so one busy kind does not end up in one task; the
    latest samples of all salts contain the latest samples of the kind.
    """
    spark: SparkSession = samples.sparkSession

    def handle(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    # The state needs RocksDB, and no more partitions than a kind has salts.
    with state_settings(spark, salts):
        salted = samples.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int"))
        state = salted.groupBy("kind", "salt").transformWithStateInPandas(
            statefulProcessor=LatestSamples(window), outputStructType=_SAMPLES, outputMode="Update", timeMode="None"
        )
        run_available(state, handle, checkpoint, mode="update")
    emitted = spark.read.schema(f"{_SAMPLES}, batch long").parquet(out)
    newest = emitted.groupBy("kind", "salt").agg(F.max("batch").alias("batch"))  # holds the whole state of a key
    return latency_percentiles(emitted.join(newest, ["kind", "salt", "batch"]), window)
