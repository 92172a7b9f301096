"""Neighbour voting and the published form of a prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbank.settings import CONFIDENCE_THRESHOLD, NEAR_EXACT_SIM, SCORE_DIGITS


def vote(hits: DataFrame, near_exact: float | None = NEAR_EXACT_SIM) -> DataFrame:
    """One prediction per query from its ranked neighbours.

    The label with (most votes, best similarity, earliest rank) wins, its best similarity is the
    score. With ``near_exact`` a top-1 neighbour at least that similar overrules the vote.
    Both groupings reuse the partitioning by query that the top-k left behind.
    """
    neighbor = F.struct("rank", "species", "sim")
    per_label = hits.groupBy("query_id", "species").agg(
        F.count(F.lit(1)).alias("votes"),
        F.max("sim").alias("best"),
        F.min("rank").alias("first"),
        F.collect_list(neighbor).alias("members"),  # at most k in all
    )
    strength = F.struct("votes", "best", -F.col("first"))
    voted = per_label.groupBy("query_id").agg(
        F.max_by(F.struct("species", "best", "votes"), strength).alias("winner"),
        F.min_by(F.struct("species", "best"), "first").alias("top"),
        F.array_sort(F.flatten(F.collect_list("members"))).alias("neighbors"),
    )
    overruled = F.lit(False)
    if near_exact is not None:
        # Rank 1 is the best of its own label, so top.best is the top-1 similarity.
        overruled = (F.col("top.species") != F.col("winner.species")) & (F.col("top.best") >= near_exact)
    return voted.select(
        "query_id",
        F.when(overruled, F.col("top.species")).otherwise(F.col("winner.species")).alias("species"),
        F.when(overruled, F.col("top.best")).otherwise(F.col("winner.best")).alias("score"),
        F.col("winner.votes").alias("votes"),
        overruled.alias("overruled"),
        F.transform(
            "neighbors", lambda n: F.struct(n["species"].alias("species"), n["sim"].alias("score"))
        ).alias("neighbors"),
    )


def is_confident(score: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """Compares the score before rounding."""
    return score >= F.lit(threshold)


def publish_prediction(
    predictions: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
    include_embedding: bool = False,
) -> DataFrame:
    """Rounded prediction rows; ``include_embedding`` also rounds and keeps ``vec``.

    ``bank_version`` and the two latencies are published when the input carries them.
    """
    columns = [
        "query_id",
        "species",
        F.round("score", SCORE_DIGITS).alias("score"),
        is_confident(F.col("score"), threshold).alias("confident"),
        F.lit(threshold).alias("threshold"),
        F.transform(
            "neighbors",
            lambda n: F.struct(n["species"].alias("species"), F.round(n["score"], SCORE_DIGITS).alias("score")),
        ).alias("neighbors"),
    ]
    if "bank_version" in predictions.columns:
        columns.append("bank_version")
    if {"embed_ms", "match_ms"} <= set(predictions.columns):
        columns.append(
            F.struct(F.round("embed_ms", 2).alias("embed"), F.round("match_ms", 2).alias("match")).alias("timing_ms")
        )
    if include_embedding:
        columns.append(F.transform("vec", lambda x: F.round(x.cast("double"), SCORE_DIGITS)).alias("embedding"))
    return predictions.select(*columns)


def confident_only(predictions: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    return predictions.filter(is_confident(F.col("score"), threshold))
