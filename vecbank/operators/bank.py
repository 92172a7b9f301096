"""Building and checking a bank: union, row checks, statistics, fingerprint, migration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecbank.functions.vectors import from_json_text, has_dim, is_finite, list_matrix, matrix_list, norm, pack_list
from vecbank.settings import FINGERPRINT_BLOCK, FINGERPRINT_CHARS, MIN_NORM


def packed(
    rows: DataFrame, column: str = "vec", normalize: bool = False, floor: float = 0.0, half: bool = False
) -> DataFrame:
    """``rows`` with a vector column as fp32 bytes, optionally brought to unit length or fp16 precision first.

    A plan node of its own instead of a UDF column: the planner may lose a Python UDF whose argument
    is a higher-order function. Nulls stay null; normalising needs equally long vectors.
    """
    schema = T.StructType(
        [T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in rows.schema.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(column)
            if batch.num_rows and normalize:
                matrix = list_matrix(vec)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                vec = matrix_list(matrix / np.where(length < floor, 1.0, length), pa.float32())
            if batch.num_rows and half:
                vec = matrix_list(list_matrix(vec, np.float16), pa.float16())
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pack_list(vec))

    return rows.mapInArrow(run, schema)


def bank_union(base: DataFrame, learned: DataFrame, base_rows: int | None = None) -> DataFrame:
    """Base rows first, learned rows after them in ``seq`` order (``row_id = base rows + seq``).

    base: ``row_id, species, vec`` with ids 0..n-1; learned: ``seq, species, vec`` with unique, not
    negative numbers. Row ids order the bank; behind the base they may have gaps.
    """
    offset = base.count() if base_rows is None else base_rows
    placed = learned.select((F.col("seq") + offset).alias("row_id"), "species", "vec", F.lit("learned").alias("origin"))
    return base.select("row_id", "species", "vec", F.lit("base").alias("origin")).unionByName(placed)


def join_positions(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labels and vectors by position; a position that only one side has is an error."""
    both = labels.withColumn("_l", F.lit(True)).join(vectors.withColumn("_v", F.lit(True)), "row_id", "full")
    complete = F.col("_l").isNotNull() & F.col("_v").isNotNull()
    message = F.lit("labels and vectors differ in length")
    return both.filter(F.when(complete, True).otherwise(F.raise_error(message).cast("boolean"))).drop("_l", "_v")


def row_verdict(vec: Column, dim: int) -> Column:
    """Why a row cannot enter a bank: ``wrong_dim``, ``not_finite``, ``zero`` or ``ok``."""
    return (
        F.when(~has_dim(vec, dim), "wrong_dim")
        .when(~F.coalesce(is_finite(vec), F.lit(False)), "not_finite")
        .when(norm(vec) <= MIN_NORM, "zero")
        .otherwise("ok")
    )


def usable_rows(bank: DataFrame, dim: int) -> DataFrame:
    """Rows a bank keeps at load: right width, finite, not zero."""
    return bank.filter(row_verdict(F.col("vec"), dim) == "ok")


def bank_stats(bank: DataFrame) -> DataFrame:
    """``vectors, species, learned, dim, mixed_dims``."""
    return bank.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_distinct("species").alias("species"),
        F.count_if(F.col("origin") == "learned").alias("learned"),
        F.max(F.size("vec")).alias("dim"),
        (F.max(F.size("vec")) != F.min(F.size("vec"))).alias("mixed_dims"),
    )


def _digest(parts: Column) -> Column:
    return F.sha1(parts.cast("binary"))


def row_hash(species: Column, packed_vec: Column) -> Column:
    """Hash of one bank row over its label and the fp32 bytes of its vector."""
    return F.sha1(F.concat(species.cast("binary"), F.lit("\n").cast("binary"), packed_vec))


def fingerprint_blocks(rows: DataFrame, block: int = FINGERPRINT_BLOCK) -> DataFrame:
    """``block_id, rows, digest`` from ``row_id, row_hash``; a block never exceeds ``block`` rows.

    Appending rows changes only the last block and adds new ones, so stored full blocks are reused:
    hash the rows from the first incomplete block on and unite the result with the stored ones.
    """
    return rows.groupBy(F.floor(F.col("row_id") / block).cast("long").alias("block_id")).agg(
        F.count(F.lit(1)).alias("rows"), _digest(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row_id", "row_hash"))), lambda r: r["row_hash"]), ""
        )).alias("digest"),
    )


def extend_blocks(stored: DataFrame, rows: DataFrame, block: int = FINGERPRINT_BLOCK) -> DataFrame:
    """Blocks after an append: full stored blocks are kept, only rows beyond them are hashed."""
    full = stored.filter(F.col("rows") == block)
    first = full.agg(F.coalesce(F.max("block_id") + 1, F.lit(0))).first()[0] * block
    return full.unionByName(fingerprint_blocks(rows.filter(F.col("row_id") >= first), block))


def combine_blocks(blocks: DataFrame, model_id: str, block: int = FINGERPRINT_BLOCK) -> DataFrame:
    """``fingerprint, vectors``: the block digests folded level by level, then hashed with the model id.

    A level shrinks the table by ``block``, so no task concatenates more than ``block`` digests.
    """
    vectors = blocks.agg(F.sum("rows").alias("n"), F.max("block_id").alias("last")).first()
    level, last = blocks.select("block_id", "digest"), vectors["last"] or 0
    while last >= block:
        level = fingerprint_blocks(level.select(F.col("block_id").alias("row_id"), F.col("digest").alias("row_hash")), block)
        level, last = level.select("block_id", "digest"), last // block
    root = level.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block_id", "digest"))), lambda r: r["digest"]), ""
        ).alias("digests")
    )
    digest = _digest(F.concat(F.lit(model_id), F.lit("\n"), "digests"))
    return root.select(
        F.substring(digest, 1, FINGERPRINT_CHARS).alias("fingerprint"),
        F.lit(vectors["n"] or 0).cast("long").alias("vectors"),
    )


def migrate_json_vectors(rows: DataFrame) -> DataFrame:
    """``id, species, vec_bytes, accepted``: JSON text vectors as fp32 bytes; broken ones are rejected."""
    parsed = rows.select("id", "species", from_json_text(F.col("vec_text")).alias("vec_bytes"))
    return packed(parsed, "vec_bytes").withColumn("accepted", F.col("vec_bytes").isNotNull())
