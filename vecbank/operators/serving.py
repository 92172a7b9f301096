"""Serving-side operators: result order, embedding reuse, counters, latencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecbank.settings import LATENCY_WINDOW


def ordered_results(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every request with its result; ``ok`` is false where there is none (an unreadable input)."""
    found = results.withColumn("_found", F.lit(True))
    joined = requests.join(found, keys, "left")
    return joined.withColumn("ok", F.coalesce("_found", F.lit(False))).drop("_found")


def embed_distinct(
    items: DataFrame, content: str, hash_expr: Column, embed: Callable[[DataFrame], DataFrame],
    cache: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Embed every distinct content once and give all its copies the same vector.

    Returns (items without their content but with ``hash, vec``; cache rows ``hash, vec``). ``embed`` gets ``hash, content`` rows
    and returns ``hash, vec``. Hashes that ``cache`` holds are not embedded again. ``dropDuplicates``
    combines on the map side, so a content with very many copies stays cheap.
    """
    hashed = items.withColumn("hash", hash_expr)
    distinct = hashed.filter(F.col("hash").isNotNull()).select("hash", F.col(content).alias("content"))
    distinct = distinct.dropDuplicates(["hash"])
    if cache is not None:
        distinct = distinct.join(cache.select("hash"), "hash", "left_anti")
    vectors = embed(distinct)
    if cache is not None:
        vectors = cache.unionByName(vectors)
    # The content itself stays out of the join; a very frequent hash is split by the adaptive join.
    return hashed.drop(content).join(vectors, "hash", "left"), vectors


def counters(results: DataFrame) -> DataFrame:
    """``predictions, unreadable`` of result rows carrying ``ok``."""
    return results.agg(F.count_if("ok").alias("predictions"), F.count_if(~F.col("ok")).alias("unreadable"))


def last_samples(samples: DataFrame, window: int = LATENCY_WINDOW) -> DataFrame:
    """The latest ``window`` rows per ``kind`` by ``seq`` (pruned per task before the shuffle)."""
    latest = Window.partitionBy("kind").orderBy(F.desc("seq"))
    return samples.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= window).drop("_n")


def latency_percentiles(samples: DataFrame, window: int = LATENCY_WINDOW) -> DataFrame:
    """``kind, n, p50, p95`` over the latest samples, interpolated and rounded to 2 places."""
    return (
        last_samples(samples, window)
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.percentile("ms", F.lit(0.5)), 2).alias("p50"),
            F.round(F.percentile("ms", F.lit(0.95)), 2).alias("p95"),
        )
    )
