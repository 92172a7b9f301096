"""Bank versions: immutable folders plus an append-only manifest.

Every change writes new files first and then one manifest row; readers pin the newest row once. A
reader therefore never sees half a change, and a failed job leaves the previous version active.
One writer at a time, any number of readers.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import from_bytes, is_finite, norm
from vecbank.operators.bank import bank_union, packed, row_verdict
from vecbank.operators.changes import forget_label, latest_learned, without
from vecbank.operators.learn import label_table
from vecbank.settings import PUBLISH_MIN_NORM

MANIFEST_SCHEMA = (
    "version long, generation long, op string, base string, learned string, last_batch long, "
    "model_id string, dim int, dtype string, rows long, source string, source_batch long, written_at long"
)
BASE_SCHEMA = "row_id long, species string, vec binary"
LABEL_SCHEMA = "species string, row_id long, count long"
LEARNED_SCHEMA = "seq long, species string, vec binary, t long"


class DimensionMismatch(RuntimeError):
    """The model and the bank disagree on the vector width; the old version stays active."""


def _labels_path(base: str) -> str:
    return f"{base}-labels"


class BankStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        """All versions; an unborn bank has none."""
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.root}/manifest")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)

    def active(self) -> Row | None:
        """The newest version. Call it once per job and keep the row: that pins the snapshot."""
        return self.manifest().orderBy(F.desc("version")).first()

    def _commit(self, previous: Row | None, op: str, new_generation: bool, steps: int = 1, **changes) -> Row:
        row = previous.asDict() if previous else {
            "version": 0, "generation": 0, "base": None, "learned": None, "last_batch": -1,
            "model_id": None, "dim": None, "dtype": None, "rows": 0,
        }
        row.update(source=None, source_batch=None)
        row.update(changes, op=op, version=row["version"] + steps, written_at=int(time.time()))
        row["generation"] += int(new_generation)
        fields = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]
        line = self.spark.createDataFrame([tuple(row[f] for f in fields)], MANIFEST_SCHEMA)
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return Row(**{f: row[f] for f in fields})

    def publish(self, bank: DataFrame, model_id: str, dim: int, dtype: str = "fp16", normalize: bool = True) -> Row:
        """Write a new base (``row_id, species, vec``) and make it active; learned rows stay in effect.

        Rows whose vector is null, zero or not finite are left out; ``source`` of the version tells how
        many there were. The others are normalised once more and rounded to ``dtype``. A base of
        another width than ``dim`` is refused before anything becomes visible.
        """
        previous = self.active()
        path = f"{self.root}/base/{uuid.uuid4().hex}"
        usable = is_finite(F.col("vec")) & (norm(F.col("vec")) > PUBLISH_MIN_NORM)
        found = bank.agg(F.count(F.lit(1)).alias("rows"), F.count_if(usable & (F.size("vec") != dim)).alias("wrong")).first()
        if found["wrong"]:
            raise DimensionMismatch(f"{found['wrong']} vectors do not have {dim} values")
        rows = bank.select("row_id", "species", "vec").filter(usable)
        # Clustered by label (a hot label spans several files), so teaching reads only the files it needs.
        clustered = rows.repartitionByRange("species", "row_id").sortWithinPartitions("species", "row_id")
        packed(clustered, normalize=normalize, floor=PUBLISH_MIN_NORM, half=dtype == "fp16").write.parquet(path)
        label_table(self.spark.read.schema(BASE_SCHEMA).parquet(path)).write.parquet(_labels_path(path))
        kept = self.spark.read.schema(BASE_SCHEMA).parquet(path).count()
        return self.activate(previous, path, model_id, dim, dtype, dropped=found["rows"] - kept)

    def activate(self, previous: Row | None, path: str, model_id: str, dim: int, dtype: str, dropped: int = 0) -> Row:
        """Swap model and base together, after checking the base; on failure the old one stays."""
        checked = self.spark.read.schema(BASE_SCHEMA).parquet(path).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.octet_length("vec") != 4 * dim).alias("wrong")
        ).first()
        if checked["wrong"]:
            raise DimensionMismatch(f"{checked['wrong']} vectors of {path} do not have {dim} values")
        learned = previous["learned"] if previous and previous["dim"] == dim else None
        last = previous["last_batch"] if learned else -1
        return self._commit(
            previous, "publish", True, base=path, model_id=model_id, dim=dim, dtype=dtype, rows=checked["rows"],
            learned=learned, last_batch=last, source=f"dropped={dropped}" if dropped else None,
        )

    def base(self, version: Row) -> DataFrame:
        """``row_id, species, vec`` with packed vectors: they reach a task as one block of bytes."""
        return self.spark.read.schema(BASE_SCHEMA).parquet(version["base"])

    def labels(self, version: Row) -> DataFrame:
        """``species, row_id, count`` of a version: stored for the base, counted for the learned rows."""
        base = self.spark.read.schema(LABEL_SCHEMA).parquet(_labels_path(version["base"]))
        if not version["learned"]:
            return base
        learned = label_table(self.packed_bank(version).filter(F.col("origin") == "learned"))
        return base.unionByName(learned).groupBy("species").agg(
            F.min("row_id").alias("row_id"), F.sum("count").alias("count")
        )

    def learned(self, version: Row) -> DataFrame:
        """``seq, species, vec, t`` visible in a version, vectors packed."""
        if not version["learned"]:
            return self.spark.createDataFrame([], LEARNED_SCHEMA)
        rows = self.spark.read.schema(LEARNED_SCHEMA + ", batch long").parquet(version["learned"])
        return rows.filter(F.col("batch") <= version["last_batch"]).drop("batch")

    def packed_bank(self, version: Row) -> DataFrame:
        """``row_id, species, vec, origin``: base rows first, then usable learned rows."""
        if not version["learned"]:
            return self.base(version).withColumn("origin", F.lit("base"))
        good = self.learned(version).filter(row_verdict(from_bytes(F.col("vec")), version["dim"]) == "ok")
        return bank_union(self.base(version), good, version["rows"])

    def bank(self, version: Row) -> DataFrame:
        """The same with vectors as arrays."""
        return self.packed_bank(version).withColumn("vec", from_bytes(F.col("vec")))

    def is_committed(self, source: str, batch: int) -> bool:
        """Whether a writer (a stream, say) already added its batch."""
        mine = (F.col("source") == source) & (F.col("source_batch") >= batch)
        return not self.manifest().filter(mine).isEmpty()

    def append_learned(self, rows: DataFrame, batch: int | None = None, source: str = "") -> Row:
        """Append ``seq, species, vec``; the version rises by one per row, and by one for an empty batch
        that has to be remembered as done. Nothing added and nothing to remember changes nothing.

        ``batch`` counts the batches of one ``source``. A batch that was committed before changes
        nothing, so retries are harmless. The files are complete before the manifest row makes them
        visible, and what a failed attempt left behind is overwritten.
        """
        previous = self.active()
        if batch is not None and self.is_committed(source, batch):
            return previous
        number = previous["last_batch"] + 1
        path = previous["learned"] or f"{self.root}/learned/{uuid.uuid4().hex}"
        stamped = packed(rows.select("seq", "species", "vec")).withColumn("t", F.lit(int(time.time())).cast("long"))
        stamped.write.mode("overwrite").parquet(f"{path}/batch={number}")
        added = self.spark.read.schema(LEARNED_SCHEMA).parquet(f"{path}/batch={number}").count()
        if not added and batch is None:
            return previous
        return self._commit(
            previous, "learn", False, steps=max(added, 1), learned=path, last_batch=number,
            source=None if batch is None else source, source_batch=batch,
        )

    def forget(
        self, name: str | None = None, last: bool = False, exact: bool = False, everything: bool = False
    ) -> tuple[Row, DataFrame]:
        """Remove learned rows by name, or the latest one; a name takes precedence over ``last``. With neither,
        ``everything`` removes all learned rows (the rule of banks kept in SQL), else nothing goes.

        Base rows are never removed. Nothing to remove means no new version. Returns the active
        version and the removed rows.
        """
        previous = self.active()
        rows = self.learned(previous)
        if name:
            removed = forget_label(rows, name, exact)
        elif last:
            removed = latest_learned(rows)
        else:
            removed = rows if everything else rows.limit(0)
        if removed.isEmpty():
            return previous, removed
        path = f"{self.root}/learned/{uuid.uuid4().hex}"
        without(rows, removed).write.parquet(f"{path}/batch={previous['last_batch']}")
        return self._commit(previous, "forget", True, learned=path), removed


def newest_valid(manifest: DataFrame, dim: int) -> DataFrame:
    """The version to serve: the newest one whose width fits the model."""
    return manifest.filter(F.col("dim") == dim).orderBy(F.desc("version")).limit(1)


def write_split_features(rows: DataFrame, path: str) -> None:
    """Write ``split, label, feat`` as the split feature store (one folder per split); a rerun replaces it."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split_features(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the filter prunes the other split's folder."""
    return spark.read.parquet(path).filter(F.col("split") == split)
