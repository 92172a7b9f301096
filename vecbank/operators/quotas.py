"""Curation of labelled records: source order, quotas, split, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecbank.operators.ordered import numbered
from vecbank.session import materialize
from vecbank.settings import MAX_PER_LABEL, VAL_PER_LABEL

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def arrival_rank(df: DataFrame, label: str, order: list[str], limit: int, name: str = "place") -> DataFrame:
    """The first ``limit`` rows per label in arrival order, with their place from 1.

    The filter sits on the window, so Spark keeps only ``limit`` rows per label and task before
    the shuffle; a hot label costs no more than any other. Spark does that up to a limit of its own;
    beyond it the same places come from a two-level scan. Rows without a label are a label of their own.
    """
    if limit > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        return numbered(df, order, [label], name).filter(F.col(name) <= limit)
    window = Window.partitionBy(label).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)


def hold_out(df: DataFrame, label: str, order: list[str], val_per_label: int = VAL_PER_LABEL) -> DataFrame:
    """All rows with a ``split``: the first rows of each label are ``val``, the others ``train``.

    Only the last validation row of every label is looked up, so no label is ranked as a whole.
    """
    place = F.struct(*order)
    last = arrival_rank(df.select(label, *order), label, order, val_per_label, "_n")
    last = last.groupBy(label).agg(F.max(place).alias("_last"))
    split = F.when(place <= F.col("_last"), "val").otherwise("train")
    last = last.withColumnRenamed(label, "_label")
    return df.join(last, df[label].eqNullSafe(last["_label"]), "left").withColumn("split", split).drop("_last", "_label")


def by_source(sources: list[DataFrame]) -> DataFrame:
    """Union of sources in priority order: earlier frames rank before later ones."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for frame in ranked[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def curate(
    df: DataFrame,
    label: str,
    order: list[str],
    max_per_label: int = MAX_PER_LABEL,
    val_per_label: int = VAL_PER_LABEL,
) -> DataFrame:
    """Quota and split: the first rows of a label go to ``val``, the others up to the quota to ``train``."""
    kept = arrival_rank(df, label, order, max_per_label)
    return kept.withColumn("split", F.when(F.col("place") <= val_per_label, "val").otherwise("train"))


def collection_progress(curated: DataFrame, universe: DataFrame, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """``collected, target_total, labels, complete`` of a curation run."""
    both = (
        curated.select(F.lit(1).alias("kept"), F.lit(0).alias("label"))
        .unionAll(universe.select(F.lit(0), F.lit(1)))
        .agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("collected"), F.coalesce(F.sum("label"), F.lit(0)).alias("labels"))
    )
    return both.select(
        "collected",
        (F.col("labels") * max_per_label).alias("target_total"),
        "labels",
        (F.col("collected") >= F.col("labels") * max_per_label).alias("complete"),
    )


def collect_until_full(
    spark: SparkSession, files: list[str], schema: str, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, at_first: int = 1
) -> tuple[DataFrame, int]:
    """Quota over files (``species, arrival``) in their given order, without reading on once every label is full.

    Returns (``species, arrival, place``, files read). Files are read in runs that double in size, so a job is spent per
    doubling and at most about twice the files needed are read. A label of ``labels`` (``species``) that never fills up makes all
    files be read; rows of labels that are not among them are left out. The order is that of the files and, within one, of
    ``arrival``; the outcome is that of a scan of all files.
    """
    held = labels.select("species", F.lit(0).cast("long").alias("held")).distinct()
    kept: DataFrame | None = None
    at = 0
    while at < len(files):
        some = files[at : at + max(at_first, at)]
        name = F.col("_metadata.file_name")
        rows = spark.read.schema(schema).parquet(*some).select("species", "arrival", name.alias("file"))
        first = arrival_rank(rows, "species", ["file", "arrival"], max_per_label)
        told = held.withColumnRenamed("species", "_label")
        placed = first.join(told, first["species"].eqNullSafe(told["_label"])).select(
            "species", "arrival", (F.col("place") + F.col("held")).cast("long").alias("place")
        )
        fresh = materialize(placed.filter(F.col("place") <= max_per_label), "collected")
        kept = fresh if kept is None else kept.unionByName(fresh)
        both = held.unionByName(fresh.groupBy("species").agg(F.count(F.lit(1)).alias("held")))
        held = materialize(both.groupBy("species").agg(F.sum("held").alias("held")), "held")
        at += len(some)
        if held.filter(F.col("held") < max_per_label).isEmpty():
            break
    if kept is None:
        kept = spark.createDataFrame([], "species string, arrival long, place long")
    return kept, at


def coverage(universe: DataFrame, curated: DataFrame) -> DataFrame:
    """Every label with its number of train rows; 0 means it cannot be learned."""
    train = curated.filter(F.col("split") == "train").groupBy("species").agg(F.count(F.lit(1)).alias("train_rows"))
    return universe.select("species").join(train, "species", "left").select(
        "species",
        F.coalesce("train_rows", F.lit(0)).alias("train_rows"),
        F.col("train_rows").isNull().alias("missing"),
    )


def missing_labels(universe: DataFrame, curated: DataFrame) -> DataFrame:
    train = curated.filter(F.col("split") == "train").select("species")
    return universe.select("species").join(train, "species", "left_anti")


def shuffled(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Seeded shuffle: order by a hash of the id. Equal seeds give equal orders on any cluster."""
    return df.withColumn("shuffle_key", F.xxhash64(F.col(row_id), F.lit(seed)))
