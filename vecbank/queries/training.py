"""Training and image queries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import norm
from vecbank.operators.embedding import (
    embed_features, embed_images, feature_dropout, input_values, prepare_images, random_projection_model,
)
from vecbank.operators.head import bucket_count, train_head
from vecbank.operators.ordered import numbered
from vecbank.operators.quality import cosine_learning_rate, early_stopping
from vecbank.operators.quotas import hold_out
from vecbank.plans.identify import identify_folder
from vecbank.plans.train import build_features, curate_images, local_records
from vecbank.queries import query
from vecbank.queries.inputs import DIM, embeddings
from vecbank.session import materialize, scratch_path, table
from vecbank.sources.archives import scan_image_files, scan_images, write_files
from vecbank.sources.store import read_split_features

EPOCHS = """runs as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as epoch,
      value as score from events)"""


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    """``run, epoch, score``: the events of a user as the validation scores of a run."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("score"))
    return numbered(rows, ["ts", "event_id"], ["run"], "epoch").select("run", "epoch", "score")


@query(
    "early_stopping",
    f"""with {EPOCHS}, marked as (select *, score > greatest(coalesce(max(score) over (partition by run order by epoch
        rows between unbounded preceding and 1 preceding), -1), -1) as improved from runs),
    gains as (select *, max(case when improved then epoch else 0 end) over (partition by run order by epoch) as gain from marked),
    stops as (select run, min(epoch) filter (epoch - gain >= 15) as stop_epoch, max(epoch) as last_epoch from gains group by 1),
    bests as (select run, stop_epoch, coalesce(stop_epoch, last_epoch) as epochs_run, max(gain) as best_epoch
              from gains join stops using (run) where epoch <= coalesce(stop_epoch, last_epoch) group by 1, 2, 3)
    select b.run, r.score as best_score, b.best_epoch, b.stop_epoch, b.epochs_run
    from bests b join runs r on r.run = b.run and r.epoch = b.best_epoch""",
)
def stopping(spark: SparkSession, sf: str) -> DataFrame:
    return early_stopping(_epochs(spark, sf))


@query(
    "lr_schedule",
    f"""with {EPOCHS} select run, epoch, round(0.001::DOUBLE * (1 + cos(pi() * (epoch - 1) / 200)) / 2 * 1000000, 6) as micro_rate
    from runs""",
)
def learning_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = cosine_learning_rate(F.col("epoch") - 1, epochs=200) * 1000000
    return _epochs(spark, sf).select("run", "epoch", F.round(rate, 6).alias("micro_rate"))


@query("train_head")
def head_training(spark: SparkSession, sf: str) -> DataFrame:
    """Head training over all embeddings as features: one row per epoch."""
    rows = hold_out(embeddings(spark, sf), "species", ["row_id"])
    label = F.regexp_extract("species", r"(\d+)$", 1).cast("int")
    rows = materialize(rows.select(F.col("row_id").alias("id"), label.alias("label"), F.col("vec").alias("feat"), "split"), "features")
    train, val = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "val")
    classes = rows.agg(F.max("label") + 1).first()[0]
    _, history = train_head(train, val, classes, dim=32, epochs=3, batch=128, seed=1)
    # One record per epoch.
    return spark.createDataFrame(
        [(h["epoch"], h["lr"], h["loss"], h["train_acc"], h["val_acc"], h["val_retrieval"], h["improved"]) for h in history],
        "epoch int, lr double, loss double, train_acc double, val_acc double, val_retrieval double, improved boolean",
    )


@query(
    "train_head_partitions",
    """with places as (select row_number() over (partition by label order by vec_id) as place from embeddings),
    sizes as (select count(*) filter (place > 2) as train_rows, count(*) filter (place <= 2) as val_rows from places)
    select epoch::int as epoch, train_rows, val_rows, ceil(train_rows / 256.0)::bigint as local_runs,
           round(0.005 * (1 + cos(pi() * (epoch - 1) / 3)), 6) as lr, 1::bigint as outcomes, true as learned
    from sizes, range(1, 4) e(epoch)""",
)
def head_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Three epochs of averaged local runs on 8 and 64 partitions of the same rows, laid out differently: one outcome, a falling loss."""
    rows = hold_out(embeddings(spark, sf), "species", ["row_id"])
    label = F.regexp_extract("species", r"(\d+)$", 1).cast("int")
    rows = materialize(rows.select(F.col("row_id").alias("id"), label.alias("label"), F.col("vec").alias("feat"), "split"), "features")
    classes = rows.agg(F.max("label") + 1).first()[0]
    sizes = rows.groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in sizes}
    histories = [
        train_head(parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "val"), classes, dim=32, epochs=3, lr=0.01,
                   batch=64, seed=1, local_steps=4)[1]
        for parts in (rows.repartition(8, "id"), rows.repartition(64, "feat"))
    ]
    told = [[tuple(round(e[k], 6) for k in ("loss", "train_acc", "val_acc")) for e in h] for h in histories]
    learned = all(h[-1]["loss"] < h[0]["loss"] for h in histories)
    return spark.createDataFrame(
        [(e["epoch"], n["train"], n["val"], bucket_count(n["train"], 64, 4), round(e["lr"], 6), len({t[i] for t in told}), learned)
         for i, e in enumerate(histories[0])],
        "epoch int, train_rows long, val_rows long, local_runs long, lr double, outcomes long, learned boolean",
    )


@query("embed_batch", "select vec_id, 16 as dim, round(1.0::DOUBLE, 4) as norm from embeddings")
def embed_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Batch inference with a seeded linear model."""
    model = random_projection_model(DIM, 16, seed=5)
    rows = table(spark, sf, "embeddings").select("vec_id", embed_features(F.col("embedding"), DIM, model).alias("vec"))
    return rows.select("vec_id", F.size("vec").alias("dim"), F.round(norm(F.col("vec")), 4).alias("norm"))


@query("feature_dropout")
def dropout(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    kept = feature_dropout(F.col("embedding"), F.col("vec_id"), seed=7)
    zeros = F.size(F.filter(kept, lambda x: x == 0.0))
    return rows.select("vec_id", F.size(kept).alias("dim"), zeros.alias("dropped"))


WIDTH = 24


def _png(text: str) -> bytes:
    """The bytes of a text as an RGB picture, padded with zeros to whole rows."""
    data = text.encode()
    height = max(1, -(-len(data) // (3 * WIDTH)))
    data = data.ljust(3 * WIDTH * height, b"\0")
    return _png_of(data)


def _png_of(data: bytes) -> bytes:
    """RGB rows of WIDTH pixels as a PNG file."""
    height = len(data) // (3 * WIDTH)
    lines = b"".join(b"\0" + data[i * 3 * WIDTH : (i + 1) * 3 * WIDTH] for i in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _picture_folder(spark: SparkSession, sf: str) -> str:
    """A folder with a picture per benchmark text, labelled by its first word, and one broken file per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [_png(t) if t else b"broken" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    rows = table(spark, sf, "benchmark")
    label = F.concat(F.lit("b"), F.lower(F.regexp_extract("text", r"^(\w+)", 1)))
    good = rows.select(F.concat(label, F.lit("/"), F.col("item_id").cast("string"), F.lit(".png")).alias("path"), "text")
    bad = rows.select(F.concat(label, F.lit("/broken.PNG")).alias("path"), F.lit("").alias("text")).distinct()
    other = rows.select(F.concat(label, F.lit("/notes.txt")).alias("path"), F.lit("").alias("text")).distinct()
    root = scratch_path(spark, "pictures")
    write_files(good.union(bad).union(other).mapInArrow(run, "path string, content binary"), root)
    return root


LABEL_SQL = "'b' || lower(regexp_extract(text, '^(\\w+)', 1))"


@query(
    "image_files",
    f"""select label, extension, count(*) as n from (
      select {LABEL_SQL} as label, '.png' as extension from benchmark
      union all select distinct {LABEL_SQL}, '.png' from benchmark) group by 1, 2""",
)
def image_files(spark: SparkSession, sf: str) -> DataFrame:
    files = scan_image_files(spark, _picture_folder(spark, sf))
    return files.groupBy("label", "extension").agg(F.count(F.lit(1)).alias("n"))


@query(
    "image_scan",
    f"""select label, count(*) as files, count(height) as readable, coalesce(sum(height), 0)::bigint as lines from (
      select {LABEL_SQL} as label, greatest(1, ceil(strlen(text) / (3.0 * {WIDTH})))::bigint as height from benchmark
      union all select distinct {LABEL_SQL}, null::bigint from benchmark) group by 1""",
)
def image_scan(spark: SparkSession, sf: str) -> DataFrame:
    images = scan_images(spark, _picture_folder(spark, sf))
    return images.groupBy("label").agg(
        F.count(F.lit(1)).alias("files"), F.count("image").alias("readable"),
        F.coalesce(F.sum("image.height"), F.lit(0)).alias("lines"),
    )


def _striped_folder(spark: SparkSession, sf: str) -> str:
    """A picture per benchmark text whose columns have grey levels in steps of 56, so that a resize to 224 hits whole levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for item in batch.column("item_id").to_pylist():
                line = bytes(56 * (x * (item + c) % 5) for x in range(WIDTH) for c in range(3))
                content.append(_png_of(line * (5 + item % 30)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    name = F.col("item_id").cast("string")
    path = F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string"), F.lit("/"), name, F.lit(".png")).alias("path")
    root = scratch_path(spark, "pictures")
    write_files(table(spark, sf, "benchmark").select(path, "item_id").mapInArrow(run, "path string, content binary"), root)
    return root


SIDE = 224


@query(
    "image_prep",
    f"""with levels as (select item_id, c, x, 56 * (x * (item_id + c) % 5) as level from benchmark, range(3) t(c), range({WIDTH}) u(x)),
    weights as (select o, x, greatest(0, 1 - abs(x + 0.5 - (o + 0.5) * {WIDTH} / {SIDE})) as w from range({SIDE}) t(o), range({WIDTH}) u(x)),
    resized as (select item_id, c, o, floor(sum(w * level) / sum(w) + 0.5) as level from levels join weights using (x) where w > 0 group by 1, 2, 3)
    select item_id, {3 * SIDE * SIDE}::bigint as n_values, round(avg(level) filter (c = 0) / 255, 6) as red,
           round(avg(level) filter (c = 1) / 255, 6) as green, round(avg(level) filter (c = 2) / 255, 6) as blue,
           round(max(level) / 255, 6) as brightest from resized group by 1""",
)
def image_prep(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the channels after the resize, and the brightest value."""
    pixels = prepare_images(scan_images(spark, _striped_folder(spark, sf)), "path")
    item = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long")

    def mean(channel: int) -> Column:
        own = F.slice("pixels", channel * SIDE * SIDE + 1, SIDE * SIDE)
        return F.round(F.aggregate(own, F.lit(0.0), lambda s, x: s + F.round(x.cast("double") * 255)) / (SIDE * SIDE) / 255, 6)

    return pixels.select(
        item.alias("item_id"), F.size("pixels").cast("long").alias("n_values"), mean(0).alias("red"), mean(1).alias("green"), mean(2).alias("blue"),
        F.round(F.array_max("pixels").cast("double"), 6).alias("brightest"),
    )


@query(
    "feature_pass",
    f"""with files as (select 's' || item_id % 3 as species, item_id || '.png' as name from benchmark where 5 + item_id % 30 >= 11),
    placed as (select *, row_number() over (partition by species order by name) as place from files)
    select species, case when place <= 2 then 'val' else 'train' end as split, count(*) as rows, 32 as dim, count(*) as distinct_ids
    from placed where place <= 10 group by 1, 2""",
)
def feature_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, curate, embed every kept picture once with the frozen backbone, store by split, read back."""
    local = local_records(scan_images(spark, _striped_folder(spark, sf)))
    rows, labels, _ = curate_images(local, local.limit(0))
    path = scratch_path(spark, "features")
    build_features(materialize(rows, "curated"), random_projection_model(input_values(), 32, seed=2), path)
    parts = [read_split_features(spark, path, split) for split in ("train", "val")]
    named = parts[0].unionByName(parts[1]).join(labels.select(F.col("idx").alias("label"), "species"), "label")
    return named.groupBy("species", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("feat")).alias("dim"), F.count_distinct("id").alias("distinct_ids")
    )


@query("image_augment")
def image_augment(spark: SparkSession, sf: str) -> DataFrame:
    """Two epochs draw differently, one epoch always the same."""
    images = scan_images(spark, _picture_folder(spark, sf))
    sums = [
        prepare_images(images, "path", epoch).select(
            F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("item_id"),
            F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 3).alias(f"sum_{epoch}"),
        )
        for epoch in (1, 2)
    ]
    return sums[0].join(sums[1], "item_id")


@query(
    "identify_images",
    f"""select label, count(*) as files, count(*) filter (readable) as identified, count(*) filter (readable) as own_label
    from (select {LABEL_SQL} as label, true as readable from benchmark
          union all select distinct {LABEL_SQL}, false from benchmark) group by 1""",
)
def identify_images(spark: SparkSession, sf: str) -> DataFrame:
    """Folder -> decode -> embed -> kNN -> vote; with the pictures as bank, each finds itself (near-exact rule)."""
    root = _picture_folder(spark, sf)
    model = random_projection_model(input_values(), 32, seed=2)
    pictures = scan_images(spark, root)
    vectors = embed_images(pictures, "path", model).join(pictures.select("path", "label"), "path")
    bank = vectors.select(F.xxhash64("path").alias("row_id"), F.col("label").alias("species"), "vec")
    bank = materialize(bank.filter(F.col("vec").isNotNull()), "bank")
    found = identify_folder(spark, root, bank, model, k=1)
    own = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return found.withColumn("label", own).groupBy("label").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("identified"),
        F.count_if(F.col("species") == F.col("label")).alias("own_label"),
    )
