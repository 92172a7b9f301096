"""Exchange folders: ``base_features``, ``base_species``, ``base_meta.json`` and learned JSON lines."""

from __future__ import annotations

import json
import time
import warnings

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vecbank.operators.bank import bank_union
from vecbank.sources.files import resolve, write_atomically
from vecbank.sources.learned import read_learned, read_meta, write_learned
from vecbank.sources.npy import BANK_SCHEMA, NpySource, dense_shape, label_count, write_npy
from vecbank.sources.store import BankStore

DEFAULT_DIM = 256


def _existing(*paths: str) -> str | None:
    for path in paths:
        fs, name = resolve(path)
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            return path
    return None


def load_folder(spark: SparkSession, folder: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(``row_id, species, vec, origin``, width) of an exchange folder; single files or folders of shards.

    A missing base gives an empty one of ``dim`` values. Differing lengths are an error, a metadata
    width that disagrees with the file is a warning. Bad learned lines are skipped.
    """
    features = _existing(f"{folder}/base_features.npy", f"{folder}/base_features")
    if features is None:
        base, rows, dim = spark.createDataFrame([], BANK_SCHEMA), 0, dim or DEFAULT_DIM
    else:
        labels = _existing(f"{folder}/base_species.npy", f"{folder}/base_species")
        rows, dim = dense_shape(features)
        if labels is None or label_count(labels) != rows:
            raise ValueError(f"labels and vectors of {folder} differ in length")
        spark.dataSource.register(NpySource)
        base = spark.read.format("npy").option("labels", labels).load(features)
        meta = read_meta(spark, f"{folder}/base_meta.json").first()
        if meta and meta["dim"] and meta["dim"] != dim:
            warnings.warn(f"metadata says {meta['dim']} values per vector, the file has {dim}", stacklevel=2)
    lines = _existing(f"{folder}/learned.jsonl", f"{folder}/learned")
    if lines is None:
        return base.withColumn("origin", F.lit("base")), dim
    return bank_union(base, read_learned(spark, lines, dim), rows), dim


def export_folder(store: BankStore, version: Row, folder: str) -> int:
    """Write one version as an exchange folder (sharded); returns the number of base rows."""
    bank = store.bank(version)
    rows = write_npy(bank.filter(F.col("origin") == "base"), folder, version["dtype"])
    meta = {
        "rows": rows, "dim": version["dim"], "dtype": version["dtype"], "model_path": None,
        "model_sha1": version["model_id"], "written_at": int(time.time()), "source": "vecbank",
    }
    write_atomically(f"{folder}/base_meta.json", [json.dumps(meta, indent=2).encode()], "meta")
    if version["learned"]:
        learned = bank.filter(F.col("origin") == "learned").withColumn("t", F.lit(version["written_at"]))
        # In row order, because the line order is the order of learning.
        ordered = learned.repartitionByRange("row_id").sortWithinPartitions("row_id")
        write_learned(ordered, f"{folder}/learned")
    return rows
