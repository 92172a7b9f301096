"""Teaching: validation, name resolution, near-duplicate rejection in request order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbank.functions.names import is_valid_name, name_key, new_name, strip
from vecbank.functions.vectors import as_double, is_usable, l2_normalize, list_matrix
from vecbank.operators.blocks import BLOCK_ROWS, blocked_join, group_bounds, map_sorted_groups
from vecbank.operators.naming import name_index, suggest_names
from vecbank.operators.ordered import numbered
from vecbank.operators.quotas import arrival_rank
from vecbank.session import materialize, scratch_path
from vecbank.settings import DUPLICATE_SIM

#: Items of a label that the first round settles in order; every round takes twice as many, up to the larger number.
HEAD_ROWS, MOST_HEAD_ROWS = 1000, 8000
#: Rows of either side that meet in a task. Every further block of one side copies the other side, so blocks are as large as memory allows.
SIDE_ROWS = 8 * BLOCK_ROWS


def _best_similarity(items: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """The largest dot product of each item with the rows of the bank, some thousand pairs of rows at a time."""
    out = np.full(len(items), -np.inf)
    for a in range(0, len(items), BLOCK_ROWS // 4):
        for b in range(0, len(bank), BLOCK_ROWS):
            part = slice(a, a + BLOCK_ROWS // 4)
            np.maximum(out[part], (items[part] @ bank[b : b + BLOCK_ROWS].T).max(axis=1), out=out[part])
    return out


def max_similarity(items: DataFrame, rows: DataFrame, block_rows: int = SIDE_ROWS) -> DataFrame:
    """``item_id, max_sim``: the best dot product of an item with the rows of its own species.

    items: ``item_id, species, vec``; rows: ``row_id, species, vec`` (or packed bytes). Rows with a value that is not finite
    match nothing; items whose species has no other row are absent. Blocks emit one number per item, never a pair.
    """

    def kernel(left: pa.Table, right: pa.Table) -> pa.RecordBatch | None:
        bank = list_matrix(right.column("vec"))
        bank = bank[np.isfinite(bank).all(axis=1)]
        if not len(bank):
            return None
        best = _best_similarity(list_matrix(left.column("item_vec")), bank)
        return pa.RecordBatch.from_arrays(
            [left.column("item_id").combine_chunks(), pa.array(best)], names=["item_id", "max_sim"]
        )

    partial = blocked_join(
        items.select("item_id", "species", as_double(F.col("vec")).alias("item_vec")),
        rows.select("row_id", "species", "vec"),
        "species", "item_id", "row_id", kernel, "item_id long, max_sim double", block_rows, block_rows,
    )
    return partial.groupBy("item_id").agg(F.max("max_sim").alias("max_sim"))


def accept_in_order(vectors: np.ndarray, dup_sim: float) -> np.ndarray:
    """Greedy pass: a vector is accepted unless it is too close to one accepted before it."""
    alive = np.ones(len(vectors), dtype=bool)
    for i in range(len(vectors)):
        if alive[i] and i + 1 < len(vectors):
            alive[i + 1 :] &= vectors[i + 1 :] @ vectors[i] < dup_sim
    return alive


def _greedy_heads(heads: DataFrame, dup_sim: float) -> DataFrame:
    """Run the greedy pass over the (bounded) head of every species. ``last`` is the last id of the head."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = group_bounds(table, ["species"])
        vectors = list_matrix(table.column("vec"))
        accepted = np.concatenate([accept_in_order(vectors[a:b], dup_sim) for a, b in zip(bounds[:-1], bounds[1:])])
        last = table.column("item_id").take(pa.array(np.repeat(bounds[1:] - 1, np.diff(bounds))))
        yield from table.append_column("accepted", pa.array(accepted)).append_column("last", last).to_batches()

    return map_sorted_groups(
        heads.select("item_id", "species", "vec"), ["species"], ["item_id"], run,
        "item_id long, species string, vec array<double>, accepted boolean, last long",
    )


def _undecided(left: DataFrame, fresh: DataFrame, dup_sim: float, most_fresh: int, block_rows: int) -> DataFrame:
    """Rows of ``left`` that come after the head of their species and are not too close to what was accepted of it (``fresh``).

    All that was accepted of a head is one block, so a task decides on its rows and passes them on: they travel once.
    """

    def kernel(items: pa.Table, head: pa.Table) -> pa.RecordBatch | None:
        items = items.select(["item_id", "species", "vec"])
        items = items.filter(pc.greater(items.column("item_id"), head.column("last")[0]))
        if not items.num_rows:
            return None
        bank = list_matrix(head.column("vec"))
        bank = bank[np.isfinite(bank).all(axis=1)]
        if len(bank):
            items = items.filter(pa.array(_best_similarity(list_matrix(items.column("vec")), bank) < dup_sim))
        return items.combine_chunks().to_batches()[0] if items.num_rows else None

    return blocked_join(
        left, fresh.select(F.col("item_id").alias("row_id"), "species", "vec", "last"), "species", "item_id", "row_id",
        kernel, "item_id long, species string, vec array<double>", block_rows, max(most_fresh, block_rows),
    )


def reject_near_duplicates(
    items: DataFrame,
    dup_sim: float = DUPLICATE_SIM,
    head_rows: int = HEAD_ROWS,
    block_rows: int = SIDE_ROWS,
) -> DataFrame:
    """Items that one-at-a-time teaching accepts: ``item_id, species`` (ids give the order).

    Sequential by nature, but not in one task. The first round settles the earliest ``head_rows`` items
    of each species in order, every later one twice as many; a round then removes, in parallel blocks,
    the later items that are too close to a newly accepted one, and moves what is left only once. Whatever is left meets the next round with nothing earlier near
    it, so the outcome equals the sequential one. Species no longer than a head need one round. Exact
    copies of an earlier item can never be accepted and are dropped before the first round.
    """
    spark = items.sparkSession
    left = items.select("item_id", "species", as_double(F.col("vec")).alias("vec"))
    if dup_sim < 1.0 - 1e-6:
        left = left.groupBy("species", "vec").agg(F.min("item_id").alias("item_id"))
    path = scratch_path(spark, "accepted")
    left = materialize(left.select("item_id", "species", "vec"), "undecided")
    for turn in itertools.count():
        most = min(head_rows << turn, max(head_rows, MOST_HEAD_ROWS))
        # Ranked without the vectors; stored, so that Spark knows how small it is.
        first = arrival_rank(left.select("item_id", "species"), "species", ["item_id"], most, "_n")
        ends = materialize(first.groupBy("species").agg(F.max("item_id").alias("_end")), "ends")
        heads = left.join(ends, "species").filter(F.col("item_id") <= F.col("_end"))
        settled = materialize(_greedy_heads(heads, dup_sim), "settled")
        # Stored per round: neither the plan nor what a lost executor repeats grows with the rounds.
        fresh = settled.filter("accepted")
        fresh.select("item_id", "species").write.parquet(f"{path}/turn={turn}")
        if settled.count() < left.count():
            left = materialize(_undecided(left, fresh.drop("accepted"), dup_sim, most, block_rows), "undecided")
        else:
            left = left.limit(0)
        if left.isEmpty():
            return spark.read.schema("item_id long, species string").parquet(path).select("item_id", "species")
    raise AssertionError("rounds end when nothing is left")


def label_table(bank: DataFrame) -> DataFrame:
    """``species, row_id, count``: first row and number of rows of every label."""
    return bank.groupBy("species").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("count"))


def _rows_of(bank: DataFrame, species: DataFrame, pushed: int = 500) -> DataFrame:
    """Bank rows of some species. A short list becomes a filter that a clustered bank can skip files by."""
    few = [r["species"] for r in species.limit(pushed + 1).collect()]
    if len(few) <= pushed:
        return bank.filter(F.col("species").isin(few))
    return bank.join(species, "species", "left_semi")


def learn(
    bank: DataFrame,
    requests: DataFrame,
    dim: int,
    dup_sim: float = DUPLICATE_SIM,
    head_rows: int = HEAD_ROWS,
    block_rows: int = SIDE_ROWS,
    with_suggestions: bool = False,
    labels: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Teach ``requests`` (``seq long, name, vec, allow_new boolean``) in ``seq`` order.

    Returns (results, learned). results has one row per request: ``seq, status, species, examples,
    suggestions``; learned holds the rows to append: ``seq, species, vec`` (normalised). The bank
    (``row_id, species, vec``) is the state before the batch; suggestions refer to that state.
    ``labels`` (see :func:`label_table`) saves scanning the bank for its names and counts.
    """
    labels = label_table(bank) if labels is None else labels
    valid = is_usable(F.col("vec"), dim) & is_valid_name(F.col("name"))
    asked = requests.select(
        "seq", strip(F.col("name")).alias("name"), "allow_new", valid.alias("valid"),
        F.when(valid, l2_normalize(F.col("vec"))).alias("vec"),
    ).withColumn("key", name_key(F.col("name")))

    known = name_index(labels).withColumnRenamed("species", "known")
    # The first admissible request of an unknown key founds the species.
    founders = (
        asked.filter(F.col("valid") & F.col("allow_new"))
        .groupBy("key")
        .agg(F.min("seq").alias("founded_at"), F.min_by(new_name(F.col("name")), "seq").alias("founded"))
    )
    resolved = asked.join(known, "key", "left").join(founders, "key", "left")
    is_known = F.col("known").isNotNull() | (F.col("seq") >= F.col("founded_at"))
    resolved = resolved.withColumn(
        "species", F.when(F.col("valid") & is_known, F.coalesce("known", "founded"))
    ).withColumn(
        "status",
        F.when(~F.col("valid"), "bad_image").when(F.col("species").isNull(), "unknown").otherwise("open"),
    )
    # Stored: several steps below read it, and the names of the bank are scanned only once.
    resolved = materialize(resolved.select("seq", "name", "species", "status", "vec"), "requests")
    open_items = resolved.filter(F.col("status") == "open").select(F.col("seq").alias("item_id"), "species", "vec")

    targets = _rows_of(bank, open_items.select("species").distinct())
    in_bank = max_similarity(open_items, targets, block_rows).filter(F.col("max_sim") >= dup_sim)
    remaining = open_items.join(in_bank.select("item_id"), "item_id", "left_anti")
    accepted = reject_near_duplicates(remaining, dup_sim, head_rows, block_rows)

    # Examples of the species right after this item was added.
    counted = numbered(accepted, ["item_id"], ["species"], "nth")
    held = labels.select("species", F.col("count").alias("held"))
    counted = counted.join(held, "species", "left").select(
        F.col("item_id").alias("seq"), (F.col("nth") + F.coalesce("held", F.lit(0))).alias("examples")
    )
    results = resolved.join(counted, "seq", "left").select(
        "seq", "name", "vec",
        F.when(F.col("status") != "open", F.col("status"))
        .when(F.col("examples").isNotNull(), "learned")
        .otherwise("duplicate")
        .alias("status"),
        "species", "examples",
    )
    learned = results.filter(F.col("status") == "learned").select("seq", "species", "vec")
    results = results.drop("vec")
    if with_suggestions:
        unknown = results.filter(F.col("status") == "unknown").select("name")
        close = suggest_names(unknown, labels)
        results = results.withColumn("word", new_name(F.col("name"))).join(close, "word", "left")
    else:
        results = results.withColumn("suggestions", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    offered = F.when(F.col("status") == "unknown", F.coalesce("suggestions", none)).otherwise(none)
    return results.select("seq", "status", "species", "examples", offered.alias("suggestions")), learned


def pair_batch(batch: DataFrame, names: str, items: str, limit: int | None = None) -> DataFrame:
    """Unfold parallel arrays into ``pos, name, item`` rows; unequal, empty or more than ``limit`` is an error."""
    n = F.size(names)
    ok = F.when(n != F.size(items), F.raise_error(F.lit("names and items must be the same length")))
    ok = ok.when(n < 1, F.raise_error(F.lit("no items in batch")))
    if limit is not None:
        ok = ok.when(n > limit, F.raise_error(F.lit(f"at most {limit} items per batch")))
    checked = batch.withColumn("_ok", ok.otherwise(F.lit(True))).filter("_ok")
    pairs = F.arrays_zip(F.col(names).alias("name"), F.col(items).alias("item"))
    kept = [c for c in batch.columns if c not in (names, items)]
    unfolded = checked.select(*kept, F.posexplode(pairs).alias("pos", "pair"))
    return unfolded.select(*kept, "pos", F.col("pair.name").alias("name"), F.col("pair.item").alias("item"))
