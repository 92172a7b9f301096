"""Identify: vectors or pictures against one pinned bank version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.admission import pixel_hash
from vecbank.functions.vectors import has_dim, is_finite, norm
from vecbank.operators.embedding import Predict, embed_images
from vecbank.operators.knn import knn
from vecbank.operators.serving import embed_distinct, ordered_results
from vecbank.operators.vote import publish_prediction, vote
from vecbank.session import materialize
from vecbank.settings import CONFIDENCE_THRESHOLD, MIN_NORM, NEAR_EXACT_SIM, TOP_K
from vecbank.sources.archives import scan_images
from vecbank.sources.store import BankStore


class EmptyBank(RuntimeError):
    """There are queries, but nothing to match them against."""


def readable(queries: DataFrame, dim: int | None = None) -> DataFrame:
    """Queries with a finite vector that is not (almost) zero, and has ``dim`` values if given."""
    ok = F.col("vec").isNotNull() & is_finite(F.col("vec")) & (norm(F.col("vec")) >= MIN_NORM)
    if dim is not None:
        ok = ok & has_dim(F.col("vec"), dim)
    return queries.filter(F.coalesce(ok, F.lit(False)))


def identify(
    queries: DataFrame,
    bank: DataFrame,
    k: int = TOP_K,
    near_exact: float | None = NEAR_EXACT_SIM,
    threshold: float = CONFIDENCE_THRESHOLD,
    bank_version: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """One row per query (``query_id, vec``): the published prediction, ``ok`` false if unreadable."""
    good = readable(queries, dim)
    if bank.isEmpty() and not good.isEmpty():
        raise EmptyBank("the feature bank is empty")
    predictions = vote(knn(good, bank, k), near_exact)
    if bank_version is not None:
        predictions = predictions.withColumn("bank_version", F.lit(bank_version).cast("long"))
    published = publish_prediction(predictions, threshold)
    return ordered_results(queries.select("query_id"), published, ["query_id"])


def identify_from_store(store: BankStore, queries: DataFrame, **options) -> DataFrame:
    """Pin the active version once and identify against it."""
    version = store.active()
    if version is None:
        raise EmptyBank("no bank was published")
    return identify(queries, store.packed_bank(version), bank_version=version["version"], dim=version["dim"], **options)


def embed_pictures(
    pictures: DataFrame, key: str, make_model: Callable[[], Predict], cache: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Embed each distinct picture once: (``key, hash, vec`` for all pictures, cache rows ``hash, vec``).

    Pictures are told apart by shape and pixels. ``cache`` holds vectors of earlier runs.
    """
    image = F.col("image")
    hashed = F.when(image.isNotNull(), pixel_hash(image["width"], image["height"], image["data"]))

    def embed(rows: DataFrame) -> DataFrame:
        return embed_images(rows.withColumnRenamed("content", "image"), "hash", make_model)

    return embed_distinct(pictures.select(key, "image"), "image", hashed, embed, cache)


def identify_folder(
    spark: SparkSession, root: str, bank: DataFrame, make_model: Callable[[], Predict], **options
) -> DataFrame:
    """Pictures of a folder: scan, decode, embed, match, vote. Adds ``path`` to the predictions."""
    pictures = scan_images(spark, root).withColumn("query_id", F.xxhash64("path"))
    vectors, _ = embed_pictures(pictures, "query_id", make_model)
    vectors = materialize(vectors.select("query_id", "vec"), "vectors")  # several steps read them; inference runs once
    return pictures.select("query_id", "path").join(identify(vectors, bank, **options), "query_id")
