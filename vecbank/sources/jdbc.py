"""A bank table in a database (``id, species, variant_name, feature_vector``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.names import is_learned
from vecbank.functions.vectors import from_bytes

FETCH_ROWS = 2000


def scan_options(url: str, table: str, lower: int, upper: int, partitions: int, **extra: str) -> dict[str, str]:
    """Range-partitioned read: every task fetches its own id range in chunks."""
    return {
        "url": url, "dbtable": table, "partitionColumn": "id", "lowerBound": str(lower),
        "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(FETCH_ROWS), **extra,
    }


def scan_bank_table(
    spark: SparkSession, url: str, table: str, partitions: int, **extra: str
) -> DataFrame:
    """``row_id, species, vec, origin`` of the table. The id bounds come from one aggregate query."""
    bounds_query = f"(select min(id) as lo, max(id) as hi from {table}) b"
    bounds = spark.read.format("jdbc").options(url=url, dbtable=bounds_query, **extra).load().first()
    lo, hi = (bounds[0] or 0), (bounds[1] or 0)
    rows = spark.read.format("jdbc").options(**scan_options(url, table, lo, hi + 1, partitions, **extra)).load()
    return rows.select(
        F.col("id").cast("long").alias("row_id"), "species", from_bytes(F.col("feature_vector")).alias("vec"),
        F.when(is_learned(F.col("variant_name")), "learned").otherwise("base").alias("origin"),
    )
