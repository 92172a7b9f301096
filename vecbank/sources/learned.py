"""The learned table as JSON lines: ``{"species", "vec": base64 fp32, "t": unix seconds}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import from_base64, has_dim
from vecbank.operators.bank import packed
from vecbank.operators.ordered import numbered

LINE_SCHEMA = "species string, vec string, t long, _corrupt_record string"
META_SCHEMA = (
    "rows long, dim int, dtype string, model_path string, model_sha1 string, written_at long, source string"
)


def scan_learned_lines(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Every non-blank line with a ``verdict``: ``ok``, ``malformed`` or ``wrong_dim``."""
    lines = spark.read.schema(LINE_SCHEMA).json(path)
    parsed = lines.withColumn("vec", from_base64(F.col("vec")))
    broken = F.col("_corrupt_record").isNotNull() | F.col("vec").isNull() | F.col("species").isNull()
    verdict = F.when(broken, "malformed").when(~has_dim(F.col("vec"), dim), "wrong_dim").otherwise("ok")
    return parsed.select("species", "vec", "t", verdict.alias("verdict"))


def read_learned(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``seq, species, vec, t`` of the good lines; ``seq`` follows file name and line order."""
    lines = spark.read.schema(LINE_SCHEMA).json(path)
    placed = lines.select(
        "species", from_base64(F.col("vec")).alias("vec"), "t", "_corrupt_record",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),  # rises within a file block
    )
    good = placed.filter(F.col("_corrupt_record").isNull() & F.col("species").isNotNull() & has_dim(F.col("vec"), dim))
    ordered = numbered(good.drop("_corrupt_record"), ["_file", "_start", "_line"], name="_n")
    return ordered.select((F.col("_n") - 1).alias("seq"), "species", "vec", "t")


def write_learned(learned: DataFrame, path: str, mode: str = "append") -> None:
    """Append ``species, vec, t`` as lines. Each call adds files, it never rewrites one."""
    lines = packed(learned.select("species", "vec", "t")).withColumn("vec", F.base64("vec"))
    lines.write.mode(mode).json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of a published bank; a missing or broken file gives no row."""
    try:
        meta = spark.read.schema(META_SCHEMA).option("multiLine", True).json(path)
    except Exception as error:  # noqa: BLE001 - the analyzer raises when the path is missing
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], META_SCHEMA)
    return meta.filter("rows is not null")  # a broken file parses to nulls
