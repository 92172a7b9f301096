"""Evaluation: parity of two embeddings, accuracy, early stopping, learning rate, throughput."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecbank.functions.vectors import as_double, dot, l2_normalize, list_matrix, matrix_list
from vecbank.operators.knn import knn
from vecbank.operators.ordered import OrderedRanges, numbered, previous_value, running_totals
from vecbank.settings import COSINE_SCALE, FLUSHES_PER_LOG, HEAD_EPOCHS, HEAD_LR, HEAD_PATIENCE, PARITY_MIN_COS

_LABELS_IN_TASK = 10000


def embedding_parity(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """``n, min_cos, mean_cos, max_abs_diff`` of two embeddings of the same items (``item_id, vec``)."""
    both = reference.join(candidate.withColumnRenamed("vec", "other"), "item_id")
    gap = F.array_max(F.zip_with(as_double(F.col("vec")), as_double(F.col("other")), lambda a, b: F.abs(a - b)))
    per_item = both.select(dot(F.col("vec"), F.col("other")).alias("cos"), gap.alias("gap"))
    return per_item.agg(
        F.count(F.lit(1)).alias("n"), F.min("cos").alias("min_cos"), F.avg("cos").alias("mean_cos"),
        F.max("gap").alias("max_abs_diff"),
    )


def require_parity(parity: DataFrame, min_cos: float = PARITY_MIN_COS) -> DataFrame:
    """Fails the job when the worst item falls below ``min_cos``."""
    ok = F.col("min_cos") >= min_cos
    return parity.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("embeddings differ")).cast("boolean")))


def retrieval_accuracy(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """``n, accuracy``: per cent of queries whose nearest bank row has their label.

    queries: ``query_id, species, vec``; bank: ``row_id, species, vec``. No queries give 0.
    """
    nearest = knn(queries, bank, k=1).select("query_id", F.col("species").alias("found"))
    hits = queries.select("query_id", "species").join(nearest, "query_id", "left")
    hit = F.coalesce((F.col("found") == F.col("species")).cast("int"), F.lit(0))
    return hits.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(hit) * 100, F.lit(0.0)).alias("accuracy")
    )


def class_centroids(rows: DataFrame) -> DataFrame:
    """Mean vector per species as class weights.

    Tasks add up their own rows first, so what is shuffled grows with labels and tasks, not with rows,
    and a hot species costs no more than another.
    """

    def flush(sums: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()),
                matrix_list(np.stack([total for _, total in sums.values()]), pa.float64()),
            ],
            names=["species", "n", "total"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.column("species").cast(pa.string()).dictionary_encode()
            codes = names.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            totals = np.add.reduceat(list_matrix(batch.column("vec"))[order], starts, axis=0)
            counts = np.diff(np.append(starts, len(order)))
            for name, n, total in zip(names.dictionary.to_pylist(), counts, totals):
                held = sums.setdefault(name, [0, 0.0])
                held[0], held[1] = held[0] + int(n), held[1] + total
            if len(sums) >= _LABELS_IN_TASK:
                yield flush(sums)
                sums = {}
        if sums:
            yield flush(sums)

    partial = rows.select("species", "vec").mapInArrow(run, "species string, n long, total array<double>")
    cells = partial.select("species", "n", F.posexplode("total").alias("pos", "x"))
    means = cells.groupBy("species", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    # One list entry per vector position.
    return means.groupBy("species").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vec")
    )


def cosine_logits(items: DataFrame, weights: DataFrame, k: int = 1, scale: float = COSINE_SCALE) -> DataFrame:
    """The k largest cosine logits per item: ``query_id, species, logit, rank``.

    The class table takes the bank's place in :func:`knn`; class ids follow the label order.
    """
    classes = numbered(weights.select("species", l2_normalize(F.col("vec")).alias("vec")), ["species"], name="_n")
    classes = classes.withColumn("row_id", F.col("_n") - 1)
    queries = items.select("query_id", l2_normalize(F.col("vec")).alias("vec"))
    return knn(queries, classes, k).withColumn("logit", F.col("sim") * scale).drop("sim", "row_id")


def head_accuracy(items: DataFrame, weights: DataFrame) -> DataFrame:
    """``n, accuracy``: per cent of items whose largest logit is their own class."""
    top = cosine_logits(items, weights).select("query_id", F.col("species").alias("found"))
    hits = items.select("query_id", "species").join(top, "query_id")
    return hits.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg((F.col("found") == F.col("species")).cast("int")) * 100, F.lit(0.0)).alias("accuracy"),
    )


def cosine_learning_rate(epoch: Column, lr: float = HEAD_LR, epochs: int = HEAD_EPOCHS) -> Column:
    """Cosine-annealed rate of an epoch (from 0)."""
    return F.lit(lr) * (1 + F.cos(F.lit(math.pi) * epoch / F.lit(max(epochs, 1)))) / 2


def early_stopping(scores: DataFrame, patience: int = HEAD_PATIENCE) -> DataFrame:
    """``run, best_score, best_epoch, stop_epoch, epochs_run`` per run of ``run, epoch, score``.

    Epochs count from 1. A strict improvement on the best so far (from -1) resets patience; the run
    stops at the epoch that makes ``patience`` stale ones. ``stop_epoch`` is null if it never does.
    """
    ranges = OrderedRanges(scores.select("run", "epoch", "score"), ["epoch"], ["run"])
    rows = ranges.with_earlier(ranges.rows, _best=(F.max("score"), F.max))
    before = ranges.in_range().rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max("score").over(before), F.col("_best"), F.lit(-1.0))
    rows = rows.withColumn("_gain", F.when(F.col("score") > best, F.col("epoch"))).drop("_best")
    rows = ranges.with_earlier(rows, _last=(F.max("_gain"), F.max))
    upto = ranges.in_range().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_gain", F.greatest(F.max("_gain").over(upto), F.col("_last")))
    stale = F.col("epoch") - F.coalesce("last_gain", F.lit(0))
    stops = rows.withColumn("_stop", F.when(stale >= patience, F.col("epoch")))
    found = stops.groupBy("run").agg(
        F.min("_stop").alias("stop_epoch"),
        F.max("epoch").alias("last_epoch"),
        # last_gain never falls, so at the first stop it is the last gain before it.
        F.min_by(F.when(F.col("_stop").isNotNull(), F.col("last_gain")), F.coalesce("_stop", F.lit(2**62))).alias("_at_stop"),
        F.max("last_gain").alias("_at_end"),
    )
    best_epoch = F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop")).otherwise(F.col("_at_end"))
    found = found.withColumn("best_epoch", best_epoch)
    picked = scores.select("run", F.col("epoch").alias("best_epoch"), F.col("score").alias("best_score"))
    return found.join(picked, ["run", "best_epoch"], "left").select(
        "run", "best_score", "best_epoch", "stop_epoch",
        F.coalesce("stop_epoch", "last_epoch").alias("epochs_run"),
    )


def throughput(flushes: DataFrame, every: int = FLUSHES_PER_LOG) -> DataFrame:
    """Rates at every ``every``-th flush: ``flush, rows, window_rate, lifetime_rate``.

    flushes: ``seq, seconds`` (seconds since the start), one row per processed item or batch, and
    ``items``. The recent rate spans the flushes since the last report.
    """
    counted = running_totals(flushes, ["seq"], flush=F.lit(1), rows=F.col("items"))
    reports = counted.filter(F.col("flush") % every == 0).withColumn("_at", F.struct("rows", "seconds"))
    reports = previous_value(reports, ["flush"], [], "_at", "_before")
    tiny = F.lit(1e-6)
    new_rows = F.col("rows") - F.coalesce(F.col("_before.rows"), F.lit(0))
    new_seconds = F.col("seconds") - F.coalesce(F.col("_before.seconds"), F.lit(0.0))
    return reports.select(
        "flush", "rows",
        (new_rows / F.greatest(new_seconds, tiny)).alias("window_rate"),
        (F.col("rows") / F.greatest(F.col("seconds"), tiny)).alias("lifetime_rate"),
    )
