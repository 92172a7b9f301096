"""Train and publish: curate, embed once, train the head, write the bank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vecbank.functions.admission import is_large_enough
from vecbank.functions.names import folder_label, pick_label_and_image
from vecbank.operators.embedding import Predict, project
from vecbank.operators.head import train_head
from vecbank.operators.naming import cap_labels, decode_labels, encode_labels, label_universe
from vecbank.operators.ordered import numbered
from vecbank.operators.quotas import by_source, collection_progress, curate
from vecbank.plans.identify import embed_pictures
from vecbank.session import materialize
from vecbank.settings import IMAGE_COLUMNS, IMAGE_EXTENSIONS, LABEL_COLUMNS, MAX_PER_LABEL, VAL_PER_LABEL
from vecbank.sources.archives import scan_image_files, scan_images
from vecbank.sources.store import BankStore, read_split_features, write_split_features


def remote_records(dataset: DataFrame, order: Column) -> DataFrame:
    """``species, image, arrival`` of a remote dataset; its columns are found by name."""
    label, image = pick_label_and_image(dataset.columns, LABEL_COLUMNS, IMAGE_COLUMNS)
    return dataset.select(
        folder_label(F.col(label)).alias("species"), F.col(image).alias("image"), order.cast("string").alias("arrival")
    )


def local_records(images: DataFrame) -> DataFrame:
    """``species, image, arrival`` of scanned local images, in path order."""
    return images.select(F.col("label").alias("species"), "image", F.col("path").alias("arrival"))


def curate_images(
    local: DataFrame,
    remote: DataFrame,
    max_labels: int = 0,
    max_per_label: int = MAX_PER_LABEL,
    val_per_label: int = VAL_PER_LABEL,
    local_names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Local images before remote ones, quotas, split. Returns (rows, label dictionary, progress).

    Unreadable and too small images are dropped before the quota counts them. ``local_names``
    (``species``) spares decoding the local images for their labels.
    """
    labels = cap_labels(label_universe(local if local_names is None else local_names, remote), max_labels)
    both = by_source([local, remote]).filter(F.col("image").isNotNull())
    large = is_large_enough(F.col("image.width"), F.col("image.height"), F.col("source_rank") == 0)
    known = encode_labels(both.filter(large), labels)
    rows = curate(known, "species", ["source_rank", "arrival"], max_per_label, val_per_label)
    return rows, labels, collection_progress(rows, labels, max_per_label)


def build_features(rows: DataFrame, make_backbone: Callable[[], Predict], path: str) -> None:
    """Embed every curated image once with the frozen backbone into the split feature store."""
    identified = rows.withColumn("id", F.xxhash64("source_rank", "arrival"))
    vectors, _ = embed_pictures(identified, "id", make_backbone)
    joined = identified.select("id", "split", F.col("idx").cast("int").alias("label")).join(vectors.select("id", "vec"), "id")
    write_split_features(joined.filter(F.col("vec").isNotNull()).withColumnRenamed("vec", "feat"), path)


def train_and_publish(
    store: BankStore, features: str, labels: DataFrame, model_id: str, dim: int, dtype: str = "fp16", **options
) -> tuple[Row, dict[str, np.ndarray], list[dict]]:
    """Train on a split feature store, embed its train rows with the best head and publish them."""
    train = read_split_features(store.spark, features, "train")
    val = read_split_features(store.spark, features, "val")
    weights, history = train_head(train, val, labels.count(), dim, **options)
    vectors = project(train.withColumnRenamed("label", "idx"), weights, ["id", "idx"])
    named = decode_labels(vectors, labels.select(F.col("idx").cast("int").alias("idx"), "species"), "idx")
    bank = numbered(named, ["id"], name="_n").withColumn("row_id", F.col("_n") - 1)
    return store.publish(bank.select("row_id", "species", "vec"), model_id, dim, dtype), weights, history


def run_training(
    store: BankStore,
    local_root: str,
    remote: DataFrame | None,
    make_backbone: Callable[[], Predict],
    features: str,
    model_id: str,
    dim: int,
    max_labels: int = 0,
    max_per_label: int = MAX_PER_LABEL,
    val_per_label: int = VAL_PER_LABEL,
    **options,
) -> tuple[Row, list[dict], DataFrame]:
    """The whole job: scan, curate, embed once, train the head, publish.

    remote: ``species, image, arrival`` (see :func:`remote_records`) or None. Returns (version, one
    record per epoch, curation progress).
    """
    local = local_records(scan_images(store.spark, local_root, IMAGE_EXTENSIONS))
    # The file listing knows the labels; no picture is opened for them.
    names = scan_image_files(store.spark, local_root, extensions=IMAGE_EXTENSIONS).select(F.col("label").alias("species"))
    remote = local.limit(0) if remote is None else remote
    rows, labels, progress = curate_images(local, remote, max_labels, max_per_label, val_per_label, names)
    rows, labels = materialize(rows, "curated"), materialize(labels, "labels")
    build_features(rows, make_backbone, features)
    version, _, history = train_and_publish(store, features, labels, model_id, dim, **options)
    return version, history, progress
