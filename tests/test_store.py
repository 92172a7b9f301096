import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbank.plans.identify import identify_from_store
from vecbank.plans.load import export_folder, load_folder
from vecbank.plans.teach import UnknownSpecies, forget
from vecbank.sources.files import write_atomically
from vecbank.sources.jdbc import scan_options
from vecbank.sources.learned import read_learned, read_meta, scan_learned_lines, write_learned
from vecbank.sources.npy import NpySource, write_npy
from vecbank.sources.store import BankStore, DimensionMismatch, read_split_features, write_split_features

BASE = [(0, "heron", [1.0, 0.0]), (1, "mr_vole", [0.0, 2.0]), (2, "x" * 70, [0.6, 0.8])]


@pytest.fixture
def store(spark, scratch):
    made = BankStore(spark, scratch("bank"))
    made.publish(spark.createDataFrame(BASE, "row_id long, species string, vec array<float>"), "m1", 2, dtype="fp32")
    return made


def learned(spark, rows):
    return spark.createDataFrame(rows, "seq long, species string, vec array<double>")


def test_publish_normalises_and_keeps_whole_labels(store):
    version = store.active()
    rows = {r.row_id: r for r in store.bank(version).collect()}
    assert rows[1].vec == [0.0, 1.0] and rows[2].species == "x" * 70
    assert (version["version"], version["generation"], version["rows"], version["dim"]) == (1, 1, 3, 2)


def test_wrong_width_is_refused_and_the_old_version_stays(spark, store):
    wide = spark.createDataFrame([(0, "a", [1.0, 2.0, 3.0])], "row_id long, species string, vec array<float>")
    with pytest.raises(DimensionMismatch):
        store.publish(wide, "m2", 2)
    assert store.active()["model_id"] == "m1" and store.bank(store.active()).count() == 3


def test_append_forget_undo(spark, store):
    rows = learned(spark, [(1, "heron", [0.0, 1.0]), (2, "mr_vole", [1.0, 0.0]), (3, "Mr. Vole", [1.0, 1.0])])
    store.append_learned(rows, batch=0)
    store.append_learned(rows, batch=0)  # a retry
    store.append_learned(learned(spark, [(4, "heron", [0.5, 0.5])]), batch=1)
    pinned = store.active()
    assert (pinned["version"], pinned["generation"]) == (5, 1)
    assert [(r.row_id, r.species) for r in store.bank(pinned).orderBy("row_id").collect()][3:] == [
        (4, "heron"), (5, "mr_vole"), (6, "Mr. Vole"), (7, "heron")
    ]
    version, summary = forget(store, "MR-VOLE")  # by key: both spellings go, base rows stay
    assert tuple(summary.first()) == (2, ["Mr. Vole", "mr_vole"])
    assert (version["version"], version["generation"]) == (6, 2)
    version, summary = forget(store, last=True)
    assert tuple(summary.first()) == (1, ["heron"]) and sorted(r.seq for r in store.learned(version).collect()) == [1]
    again, summary = forget(store, "mr vole")  # nothing left to remove
    assert again["version"] == version["version"] and summary.first().removed == 0
    with pytest.raises(UnknownSpecies):
        forget(store, "nobody")
    assert store.bank(pinned).count() == 7  # a pinned version does not change
    assert store.forget()[0]["version"] == version["version"]


def test_batches_are_counted_per_source(spark, store):
    rows = [learned(spark, [(i, "heron", [0.1 * i, 1.0])]) for i in range(4)]
    store.append_learned(rows[0], batch=0, source="a")
    store.append_learned(rows[1], batch=0, source="b")
    store.append_learned(rows[2])
    store.append_learned(rows[3], batch=0, source="b")  # a retry of b
    assert sorted(r.seq for r in store.learned(store.active()).collect()) == [0, 1, 2]
    assert store.is_committed("a", 0) and not store.is_committed("a", 1) and not store.is_committed("c", 0)


def test_species_takes_precedence_over_last(spark, store):
    store.append_learned(learned(spark, [(1, "heron", [0.0, 1.0]), (2, "mr_vole", [1.0, 0.0])]), batch=0)
    _, summary = forget(store, "heron", last=True)
    assert summary.first().species == ["heron"]


def test_republish_keeps_learned_rows(spark, store):
    store.append_learned(learned(spark, [(1, "heron", [0.0, 1.0])]), batch=0)
    store.publish(spark.createDataFrame(BASE[:2], "row_id long, species string, vec array<float>"), "m2", 2)
    assert store.bank(store.active()).filter("origin = 'learned'").count() == 1
    assert store.active()["model_id"] == "m2"


def test_unusable_learned_rows_are_dropped(spark, store):
    store.append_learned(learned(spark, [(1, "heron", [0.0, 0.0]), (2, "heron", [1.0]), (3, "heron", [0.0, 1.0])]), batch=0)
    assert [r.vec for r in store.bank(store.active()).filter("origin = 'learned'").collect()] == [[0.0, 1.0]]


def test_identify_reports_the_pinned_version(spark, store):
    queries = spark.createDataFrame([(1, [0.9, 0.1])], "query_id long, vec array<double>")
    row = identify_from_store(store, queries).first()
    assert row.species == "heron" and row.bank_version == 1


def test_split_features(spark, scratch):
    path = scratch("features")
    rows = spark.createDataFrame([("train", 1, [1.0]), ("val", 2, [2.0])], "split string, label int, feat array<float>")
    write_split_features(rows, path)
    write_split_features(rows, path)  # a rerun
    assert read_split_features(spark, path, "val").count() == 1


def test_learned_lines(spark, scratch, tmp_path):
    path = str(tmp_path / "learned.jsonl")
    good = lambda *v: __import__("base64").b64encode(np.array(v, dtype="<f4").tobytes()).decode()
    lines = [
        json.dumps({"species": "a", "vec": good(1, 2), "t": 5}), "", "   ", '{"species": "b", "vec": "tru',
        json.dumps({"species": "c", "vec": good(1, 2, 3), "t": 6}), json.dumps({"species": "d", "t": 7}),
        json.dumps({"vec": good(1, 2), "t": 8}), json.dumps({"species": "e", "vec": "@@", "t": 9}),
        json.dumps({"species": "f", "vec": good(3, 4), "t": 10}),
    ]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    assert [(r.seq, r.species, r.vec) for r in read_learned(spark, path, 2).orderBy("seq").collect()] == [
        (0, "a", [1.0, 2.0]), (1, "f", [3.0, 4.0])
    ]
    verdicts = sorted(r.verdict for r in scan_learned_lines(spark, path, 2).collect())
    assert verdicts == ["malformed"] * 4 + ["ok"] * 2 + ["wrong_dim"]
    out = scratch("lines")
    write_learned(read_learned(spark, path, 2), out)
    assert read_learned(spark, out, 2).count() == 2


def test_meta(spark, tmp_path):
    assert read_meta(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{nope")
    assert read_meta(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "ok.json").write_text(json.dumps({"rows": 3, "dim": 2, "dtype": "fp16"}, indent=2))
    assert read_meta(spark, str(tmp_path / "ok.json")).first().rows == 3


@pytest.mark.parametrize("dtype", [np.float16, np.float32])
def test_npy_files(spark, tmp_path, dtype):
    spark.dataSource.register(NpySource)
    matrix = np.random.default_rng(0).normal(size=(23, 5)).astype(dtype)
    labels = np.array([f"é{i}" for i in range(23)], dtype="U64")
    np.save(tmp_path / "base_features.npy", matrix)
    np.save(tmp_path / "base_species.npy", labels)
    vectors = spark.read.format("npy").option("rowsPerPartition", 4).load(str(tmp_path / "base_features.npy"))
    rows = vectors.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(23))
    assert np.array_equal(np.array([r.vec for r in rows], dtype=np.float32), matrix.astype(np.float32))
    names = spark.read.format("npy").load(str(tmp_path / "base_species.npy")).orderBy("row_id").collect()
    assert [r.species for r in names] == labels.tolist()
    assert vectors.rdd.getNumPartitions() == 6
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="neither"):
        spark.read.format("npy").load(str(tmp_path / "cube.npy")).collect()


def test_npy_shards_follow_row_order(spark, store, scratch):
    spark.dataSource.register(NpySource)
    rows = spark.range(100).select(F.col("id").alias("row_id"), F.lit("a").alias("species"), F.array(F.col("id").cast("float")).alias("vec"))
    out = scratch("npy")
    assert write_npy(rows.repartition(5), out, "fp16", rows_per_shard=16) == 100
    got = spark.read.format("npy").load(f"{out}/base_features")
    assert got.filter(F.col("row_id") != F.col("vec")[0]).count() == 0 and got.count() == 100


def test_jdbc_scan_is_range_partitioned():
    options = scan_options("jdbc:x", "bank", 1, 1000, 8, driver="d")
    assert (options["partitionColumn"], options["numPartitions"], options["fetchsize"], options["driver"]) == ("id", "8", "2000", "d")


def test_write_atomically(tmp_path):
    write_atomically(str(tmp_path / "a" / "b.bin"), [b"1", b"2"], "t0")
    assert (tmp_path / "a" / "b.bin").read_bytes() == b"12" and len(list((tmp_path / "a").iterdir())) == 1


def test_exchange_folder(spark, store, tmp_path):
    store.append_learned(learned(spark, [(5, "heron", [0.0, 1.0]), (3, "mr_vole", [1.0, 0.0])]), batch=0)
    folder = str(tmp_path / "folder")
    assert export_folder(store, store.active(), folder) == 3
    bank, dim = load_folder(spark, folder)
    rows = [(r.species, r.vec, r.origin) for r in bank.orderBy("row_id").collect()]
    assert dim == 2 and rows == [(r.species[:64], r.vec, r.origin) for r in store.bank(store.active()).orderBy("row_id").collect()]
    empty, dim = load_folder(spark, str(tmp_path / "none"))
    assert dim == 256 and empty.count() == 0


def test_single_files_must_agree(spark, tmp_path):
    np.save(tmp_path / "base_features.npy", np.eye(3, dtype=np.float16))
    np.save(tmp_path / "base_species.npy", np.array(["a", "b", "c"], dtype="U64"))
    (tmp_path / "base_meta.json").write_text('{"rows": 3, "dim": 7}')
    with pytest.warns(UserWarning, match="7 values"):
        bank, _ = load_folder(spark, str(tmp_path))
    assert [(r.species, r.vec) for r in bank.orderBy("row_id").collect()][1] == ("b", [0.0, 1.0, 0.0])
    np.save(tmp_path / "base_species.npy", np.array(["a", "b"], dtype="U64"))
    with pytest.raises(ValueError, match="differ in length"):
        load_folder(spark, str(tmp_path))


def test_label_table_follows_the_version(spark, store):
    store.append_learned(learned(spark, [(1, "heron", [0.0, 1.0]), (2, "new", [1.0, 0.0])]), batch=0)
    got = {r["species"]: (r["row_id"], r["count"]) for r in store.labels(store.active()).collect()}
    assert got == {"heron": (0, 2), "mr_vole": (1, 1), "x" * 70: (2, 1), "new": (5, 1)}


def test_publish_leaves_out_what_matches_nothing(spark, scratch):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [float("nan"), 1.0]), (2, "b", [0.0, 0.0]), (3, "b", None)]
    store = BankStore(spark, scratch("bank"))
    version = store.publish(spark.createDataFrame(rows, "row_id long, species string, vec array<float>"), "m", 2)
    assert (version["rows"], version["source"]) == (1, "dropped=3")


def test_empty_batches(spark, store):
    before = store.active()
    nothing = learned(spark, [(1, "heron", [0.0, 1.0])]).limit(0)
    assert store.append_learned(nothing) == before
    after = store.append_learned(nothing, batch=0)
    assert after["version"] == before["version"] + 1 and store.append_learned(nothing, batch=0) == after


def test_forget_everything(spark, store):
    store.append_learned(learned(spark, [(1, "heron", [0.0, 1.0]), (2, "new", [1.0, 0.0])]), batch=0)
    assert store.forget()[1].count() == 0
    _, removed = store.forget(everything=True)
    assert removed.count() == 2 and store.learned(store.active()).count() == 0


def test_labels_that_a_file_cannot_tell_apart_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(0, "y" * 64 + "a", [1.0]), (1, "y" * 64 + "b", [1.0])], "row_id long, species string, vec array<float>")
    with pytest.raises(Exception, match="told apart"):
        write_npy(rows, str(tmp_path / "out"))
