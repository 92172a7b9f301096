"""Evaluation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import as_double, l2_normalize, norm
from vecbank.operators.embedding import project
from vecbank.operators.quality import (
    class_centroids, cosine_logits, embedding_parity, head_accuracy, require_parity, retrieval_accuracy,
)
from vecbank.operators.quotas import hold_out
from vecbank.queries import query
from vecbank.queries.inputs import E, as_queries, blend_sql, blended, embeddings, hits_sql
from vecbank.session import table
from vecbank.settings import PUBLISH_MIN_NORM

SPLIT = """split as (select *, row_number() over (partition by species order by row_id) <= 2 as val from e),
    train as (select row_id, species, vec from split where not val), q as (select row_id, species, vec from split where val)"""


@query(
    "retrieval_accuracy",
    f"""with {E}, {SPLIT}, {hits_sql('q', 'train', 1)}
    select count(*) as n, round(avg((hits.species = q.species)::int) * 100, 6) as accuracy
    from q join hits on hits.query_id = q.row_id""",
)
def retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The first two vectors of a label are held out and searched among the others."""
    rows = hold_out(embeddings(spark, sf), "species", ["row_id"])
    val = as_queries(rows.filter(F.col("split") == "val"))
    train = rows.filter(F.col("split") == "train")
    return retrieval_accuracy(val, train).select("n", F.round("accuracy", 6).alias("accuracy"))


CENTROIDS = """cells as (select species, unnest(range(1, len(vec) + 1)) as pos, unnest(vec) as x from e),
    means as (select species, pos, avg(x) as x from cells group by 1, 2),
    raw as (select species, list(x order by pos) as vec from means group by 1),
    classes as (select row_number() over (order by species) as row_id, species,
                list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as vec from raw)"""


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    return class_centroids(embeddings(spark, sf))


@query(
    "class_centroids",
    f"""with {E}, {CENTROIDS} select species, (pos - 1)::bigint as pos, round(x, 6) + 0.0::DOUBLE as x from means""",
)
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    cells = _centroids(spark, sf).select("species", F.posexplode("vec").alias("pos", "x"))
    return cells.select("species", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query(
    "cosine_logits",
    f"""with {E}, {blend_sql('q', 0.8, 0.2)}, {CENTROIDS}, {hits_sql('q', 'classes', 3)}
    select query_id, rank::bigint as rank, species, round(30 * sim, 6) as logit from hits""",
)
def logits(spark: SparkSession, sf: str) -> DataFrame:
    items = as_queries(blended(spark, sf, 0.8, 0.2))
    top = cosine_logits(items, _centroids(spark, sf), k=3)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "species", F.round("logit", 6).alias("logit"))


@query(
    "centroid_accuracy",
    f"""with {E}, {CENTROIDS}, {hits_sql('e', 'classes', 1)}
    select count(*) as n, round(avg((hits.species = e.species)::int) * 100, 6) as accuracy
    from e join hits on hits.query_id = e.row_id""",
)
def centroid_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    items = as_queries(embeddings(spark, sf))
    return head_accuracy(items, _centroids(spark, sf)).select("n", F.round("accuracy", 6).alias("accuracy"))


@query(
    "embedding_parity",
    f"""with {E}, other as (select row_id, list_transform(vec, lambda x: round(x, 3)) as vec from e)
    select count(*) as n, round(min(list_dot_product(e.vec, o.vec)), 6) as min_cos,
           round(avg(list_dot_product(e.vec, o.vec)), 6) as mean_cos,
           round(max(list_max(list_transform(e.vec, lambda x, i: abs(x - o.vec[i])))), 6) as max_abs_diff
    from e join other o using (row_id)""",
)
def parity(spark: SparkSession, sf: str) -> DataFrame:
    reference = embeddings(spark, sf).select(F.col("row_id").alias("item_id"), as_double(F.col("vec")).alias("vec"))
    candidate = reference.withColumn("vec", F.transform("vec", lambda x: F.round(x, 3)))
    stats = require_parity(embedding_parity(reference, candidate), min_cos=0.99)
    return stats.select("n", *[F.round(c, 6).alias(c) for c in ("min_cos", "mean_cos", "max_abs_diff")])


HIDDEN = 8


def toy_weights(in_dim: int) -> dict[str, np.ndarray]:
    """Small weights given by a formula, so SQL can state them too."""
    h, d = np.mgrid[0:HIDDEN, 0:in_dim]
    a, b = np.mgrid[0:HIDDEN, 0:HIDDEN]
    return {
        "w1": ((h * 7 + d * 3) % 11 - 5) / 10.0, "b1": np.arange(HIDDEN) / 100.0,
        "w2": ((a * 5 + b * 2) % 7 - 3) / 10.0, "b2": np.full(HIDDEN, 0.05),
    }


@query(
    "projection_head",
    f"""with {E}, hidden as (select row_id, list_transform(range(0, {HIDDEN}), lambda h: greatest(0.0::DOUBLE, h / 100.0::DOUBLE
        + list_sum(list_transform(vec, lambda x, i: x * (((h * 7 + (i - 1) * 3) % 11) - 5) / 10.0::DOUBLE)))) as z from e),
    outs as (select row_id, list_transform(range(0, {HIDDEN}), lambda a: 0.05::DOUBLE
        + list_sum(list_transform(z, lambda x, i: x * (((a * 5 + (i - 1) * 2) % 7) - 3) / 10.0::DOUBLE))) as z from hidden)
    select row_id, (pos - 1)::bigint as pos, round(z[pos] / sqrt(list_dot_product(z, z)), 6) + 0.0::DOUBLE as x
    from (select row_id, z, unnest(range(1, {HIDDEN + 1})) as pos from outs)""",
)
def projection_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf).withColumnRenamed("vec", "feat")
    out = project(rows, toy_weights(64), ["row_id"]).select("row_id", F.posexplode("vec").alias("pos", "x"))
    return out.select("row_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("publishable_vectors", "select vec_id, round(1.0::DOUBLE, 6) as norm from embeddings")
def publishable(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of any length leave publishing with unit length; a zero vector would stay zero."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", l2_normalize(F.transform("embedding", lambda x: x * 5), PUBLISH_MIN_NORM).alias("vec")
    )
    return rows.select("vec_id", F.round(norm(F.col("vec")), 6).alias("norm"))
