"""The change log of a bank: forgetting, undo, counts and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbank.functions.names import is_learned, name_key
from vecbank.operators.ordered import previous_value, running_totals


def forget_label(learned: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """The learned rows a forget request removes: by name key, or by exact spelling."""
    if exact:
        return learned.filter(F.col("species") == name)
    return learned.filter(name_key(F.col("species")) == name_key(F.lit(name)))


def latest_learned(learned: DataFrame) -> DataFrame:
    """The row an undo removes: the highest ``seq`` (a distributed top-1)."""
    return learned.orderBy(F.desc("seq")).limit(1)


def without(learned: DataFrame, removed: DataFrame) -> DataFrame:
    return learned.join(removed.select("seq"), "seq", "left_anti")


def removal_summary(removed: DataFrame) -> DataFrame:
    """``removed`` rows and ``species`` (sorted, distinct; bounded by the number of labels)."""
    return removed.agg(
        F.count(F.lit(1)).alias("removed"), F.array_sort(F.collect_set("species")).alias("species")
    )


def surviving(log: DataFrame) -> DataFrame:
    """Learned rows left after all forget requests of a log (``seq, op, species``).

    A forget removes the learned rows of its label that precede it, so a row survives if it is later
    than the last forget. One value per label travels to the rows.
    """
    last = (
        log.filter(F.col("op") == "forget")
        .groupBy(name_key(F.col("species")).alias("key"))
        .agg(F.max("seq").alias("forgotten_at"))
    )
    learned = log.filter(F.col("op") == "learn").withColumn("key", name_key(F.col("species")))
    kept = learned.join(last, "key", "left").filter(
        F.col("forgotten_at").isNull() | (F.col("seq") > F.col("forgotten_at"))
    )
    return kept.drop("key", "forgotten_at")


def versions(log: DataFrame) -> DataFrame:
    """Running ``version`` and ``generation`` along a log of ``seq, op, species``.

    Every learn and every reload raises the version, and so does a forget that removed something: one
    whose label was taught since its last forget. Forgets that count and reloads also start a new
    generation. Nothing here needs a global single-task window.
    """
    label = F.concat(F.lit("="), F.coalesce(name_key(F.col("species")), F.lit("")))
    keyed = log.withColumn("_key", F.when(F.col("op") == "reload", "reload").otherwise(label))
    with_previous = previous_value(keyed, ["seq"], ["_key"], "op", "_previous")
    removed = (F.col("op") == "forget") & F.coalesce(F.col("_previous") == "learn", F.lit(False))
    changed = removed | F.col("op").isin("learn", "reload")
    rebuilt = removed | (F.col("op") == "reload")
    counted = running_totals(
        with_previous.withColumn("_changed", changed.cast("int")).withColumn("_rebuilt", rebuilt.cast("int")),
        ["seq"],
        version=F.col("_changed"),
        generation=F.col("_rebuilt"),
    )
    return counted.drop("_key", "_previous", "_changed", "_rebuilt")


def upsert_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """New ``species, count``: old counts plus deltas, never below 0. changes: ``species, delta``."""
    old = counts.select("species", F.col("count").cast("long").alias("count"))
    moved = old.unionByName(changes.select("species", F.col("delta").cast("long").alias("count")))
    return moved.groupBy("species").agg(F.greatest(F.sum("count"), F.lit(0)).alias("count"))


def learned_rows(rows: DataFrame, variant: str = "variant_name") -> DataFrame:
    return rows.filter(is_learned(F.col(variant)))
