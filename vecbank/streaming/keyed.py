"""Streams whose memory is keyed state: curation under quotas, and learning in order.

State lives in the RocksDB store of the stream's checkpoint, so a batch reads neither the bank nor what earlier batches
wrote, and a restarted stream goes on where it stopped. Every micro-batch writes its own folder; a replay replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vecbank.functions.names import is_valid_name, name_key, new_name, strip
from vecbank.functions.vectors import is_usable, l2_normalize
from vecbank.operators.learn import accept_in_order
from vecbank.settings import DUPLICATE_SIM, MAX_PER_LABEL, VAL_PER_LABEL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows that a task may hold while it looks for the first rows of every label.
HELD_ROWS = 200_000
#: Vectors in one entry of the list state.
BLOCK = 256


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Session settings for the start of a stateful query; it keeps them for its whole life."""
    wanted = {PROVIDER: ROCKSDB} | ({PARTITIONS: str(partitions)} if partitions else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_stateful(
    rows: DataFrame, out: str, checkpoint: str, on_batch: Callable[[int], None] | None = None, partitions: int | None = None
) -> StreamingQuery:
    """Process everything that is there into ``out/batch=<id>``, then stop. ``on_batch`` is called once a batch is stored,
    before the stream takes note of it; if it raises, the batch is repeated by the next run."""

    def store(batch_rows: DataFrame, batch: int) -> None:
        batch_rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if on_batch is not None:
            on_batch(batch)

    with state_settings(rows.sparkSession, partitions):
        query = (
            rows.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query


# Curation


def first_of_each(limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, the ``limit`` earliest rows of every label; what is left out cannot be within the quota.

    Bounds what a hot label sends to its state. If a task meets too many labels to hold their rows, those
    held so far are passed on, which only means that some rows more travel.
    """

    def trimmed(held: pd.DataFrame) -> pd.DataFrame:
        return held.sort_values("arrival", kind="stable").groupby("species", dropna=False, sort=False).head(limit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, None
        for batch in batches:
            schema, part = batch.schema, batch.to_pandas()
            held = trimmed(part if held is None else pd.concat([held, part]))
            if len(held) > HELD_ROWS:
                yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)
                held = None
        if held is not None and len(held):
            yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)

    return run


class Quota(StatefulProcessor):
    """Counts the rows kept of its label and passes on the next ones up to the quota."""

    def __init__(self, max_per_label: int, val_per_label: int):
        self.most, self.val = max_per_label, val_per_label

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()[0] if self.kept.exists() else 0
        first: np.ndarray = np.zeros(0, np.int64)
        for part in rows:  # never more than the room left and one part
            first = np.sort(np.r_[first, part["arrival"].to_numpy(np.int64)])[: max(self.most - kept, 0)]
        if len(first):
            self.kept.update((int(kept + len(first)),))
            place = np.arange(kept + 1, kept + 1 + len(first))
            yield pd.DataFrame({
                "species": pd.Series([None if key[0] else key[1]] * len(first), dtype=object), "arrival": first, "place": place,
                "split": np.where(place <= self.val, "val", "train"),
            })

    def close(self) -> None:
        pass


CURATED = "species string, arrival long, place long, split string"


def curate_stream(
    records: DataFrame, out: str, checkpoint: str, max_per_label: int = MAX_PER_LABEL, val_per_label: int = VAL_PER_LABEL,
    keep: Callable[[DataFrame], Column] | None = None, on_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Quota and split over a stream of ``species, arrival``: ``species, arrival, place, split`` in ``out``.

    The order is that of the micro-batches and, within one, of ``arrival``: a late record comes after what earlier batches
    brought, whatever its number. The state is one count per label; rows without label are a label of their own, rows
    without arrival are left out. Every task passes on no more rows of a label than the quota.
    """
    if keep is not None:
        records = records.filter(keep(records))
    rows = records.select("species", "arrival").filter(F.col("arrival").isNotNull())
    early = rows.mapInArrow(first_of_each(max_per_label), "species string, arrival long")
    # A null in the key would depend on how pandas shows it.
    keyed = early.withColumns({"unlabelled": F.col("species").isNull(), "label": F.coalesce("species", F.lit(""))})
    kept = keyed.groupBy("unlabelled", "label").transformWithStateInPandas(
        statefulProcessor=Quota(max_per_label, val_per_label), outputStructType=CURATED, outputMode="Update", timeMode="None"
    )
    return run_stateful(kept, out, checkpoint, on_batch)


# Learning


class Learner(StatefulProcessor):
    """Judges the requests of one name key in order, against the accepted vectors of its species."""

    def __init__(self, dup_sim: float):
        self.dup_sim = dup_sim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.species = handle.getValueState("species", "species string, examples long")
        self.blocks = handle.getListState("accepted", "block binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        n = self.species.get()[1] if self.species.exists() else 0
        self._keep(np.stack(initialState["vec"].to_numpy()))
        self.species.update((initialState["species"].iloc[0], int(n + len(initialState))))

    def _keep(self, vectors: np.ndarray) -> None:
        for at in range(0, len(vectors), BLOCK):
            self.blocks.appendValue((vectors[at : at + BLOCK].astype("<f8").tobytes(),))

    def _is_near(self, vectors: np.ndarray) -> np.ndarray:
        """Which vectors are too close to an accepted one; a block of the state at a time."""
        near = np.zeros(len(vectors), bool)
        for (block,) in self.blocks.get():
            held = np.frombuffer(block, "<f8").reshape(-1, vectors.shape[1])
            held = held[np.isfinite(held).all(axis=1)]
            if len(held) and not near.all():
                near |= (vectors @ held.T).max(axis=1) >= self.dup_sim
        return near

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)
        known = self.species.exists()
        name, examples = self.species.get() if known else (None, 0)
        valid, allowed = asked["valid"].to_numpy(bool), asked["allow_new"].to_numpy(bool)
        founders = np.flatnonzero(valid & allowed)
        since = 0 if known else founders[0] if len(founders) else len(asked)
        if not known and len(founders):
            name = asked["spelling"].iloc[since]
        open_ = np.flatnonzero(valid & (np.arange(len(asked)) >= since))
        status = np.where(valid, "unknown", "bad_image").astype(object)
        nth = np.full(len(asked), None, object)
        if len(open_):
            status[open_] = "duplicate"
            vectors = np.stack(asked["vec"].iloc[open_].to_numpy())
            fresh = np.flatnonzero(~self._is_near(vectors))
            fresh = fresh[accept_in_order(vectors[fresh], self.dup_sim)]
            taken = open_[fresh]
            status[taken] = "learned"
            nth[taken] = np.arange(examples + 1, examples + 1 + len(taken))
            self._keep(vectors[fresh])
            self.species.update((name, int(examples + len(taken))))
        is_open = np.isin(np.arange(len(asked)), open_)
        yield pd.DataFrame({
            "seq": asked["seq"], "status": status, "species": pd.Series(np.where(is_open, name, None), dtype=object),
            "examples": pd.Series(nth, dtype="Int64"),
            "vec": pd.Series([v if s == "learned" else None for v, s in zip(asked["vec"], status, strict=True)], dtype=object),
        })

    def close(self) -> None:
        pass


TAUGHT = "seq long, status string, species string, examples long, vec array<double>"


def known_examples(bank: DataFrame) -> DataFrame:
    """``key, species, vec`` of the species that names lead to: of those that share a key, the one first seen in the bank."""
    keyed = bank.select(name_key(F.col("species")).alias("key"), "species", "row_id", F.col("vec").cast("array<double>").alias("vec"))
    keyed = keyed.filter(F.length("key") > 0)
    first = keyed.groupBy("key").agg(F.min_by("species", "row_id").alias("species"))
    return keyed.join(first, ["key", "species"]).select("key", "species", "vec")


def learn_stream(
    requests: DataFrame, bank: DataFrame, out: str, checkpoint: str, dim: int, dup_sim: float = DUPLICATE_SIM,
    on_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Learn a stream of ``seq, name, vec, allow_new``; ``out`` holds ``seq, status, species, examples, vec`` (``vec`` of the learned).

    The bank (``row_id, species, vec``) is read once, as the initial state of the first batch; afterwards a batch meets only the
    state of the names it asks for. The outcome is that of one request after another, in the order of batches and, within
    a batch, of ``seq``. A request that is bad or of an unknown name changes no state. Requests of one name within a batch are judged in one
    task, as each depends on those before it: a name with very many requests at once is better served by
    :func:`vecbank.operators.learn.learn`, which settles it in parallel rounds.
    """
    valid = is_usable(F.col("vec"), dim) & is_valid_name(F.col("name"))
    spoken = strip(F.col("name"))
    asked = requests.select(
        F.coalesce(name_key(spoken), F.lit("")).alias("key"), "seq", F.coalesce(valid, F.lit(False)).alias("valid"),
        F.coalesce("allow_new", F.lit(False)).alias("allow_new"), new_name(spoken).alias("spelling"),
        F.when(valid, l2_normalize(F.col("vec"))).alias("vec"),
    )
    judged = asked.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Learner(dup_sim), outputStructType=TAUGHT, outputMode="Update", timeMode="None",
        initialState=known_examples(bank).groupBy("key"),
    )
    return run_stateful(judged, out, checkpoint, on_batch)
