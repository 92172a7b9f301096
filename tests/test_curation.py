import io
import os
import random
import time
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vecbank.functions.admission import exactly_one, file_extension, has_extension, is_large_enough, parent_folder
from vecbank.functions.pictures import augment, resize, resize_weights, to_rgb
from vecbank.operators.embedding import (
    embed_features, embed_images, feature_dropout, input_values, onnx_model, prepare_images, random_projection_model,
)
from vecbank.operators.quotas import (
    arrival_rank, by_source, collect_until_full, collection_progress, coverage, curate, hold_out,
)
from vecbank.plans.identify import embed_pictures
from vecbank.plans.train import build_features, curate_images, local_records, run_training, train_and_publish
from vecbank.queries.training import _png
from vecbank.sources.archives import expand_archives, extract_archives, scan_image_files, scan_images
from vecbank.sources.files import move_files
from vecbank.sources.shards import run_until_read, shard_stream
from vecbank.sources.store import BankStore, read_split_features
from vecbank.streaming import keyed
from vecbank.streaming.jobs import file_stream, stream_output
from vecbank.streaming.keyed import curate_stream, first_of_each


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    return [(rng.choice(["hot"] * 6 + ["a", "b", "c"]), i) for i in range(300)]


def replay(records, most, val):
    counts, out = {}, []
    for species, arrival in records:
        n = counts.get(species, 0)
        if n < most:
            counts[species] = n + 1
            out.append((species, arrival, "val" if n < val else "train"))
    return sorted(out)


def test_quota_and_split(spark, records):
    df = spark.createDataFrame(records, "species string, arrival long").repartition(7)
    got = curate(df, "species", ["arrival"], 10, 2)
    assert sorted((r.species, r.arrival, r.split) for r in got.collect()) == replay(records, 10, 2)
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_large_quotas_and_hold_out(spark, records):
    df = spark.createDataFrame(records, "species string, arrival long").repartition(7)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", 5)
    got = curate(df, "species", ["arrival"], 10, 2)
    assert sorted((r.species, r.arrival, r.split) for r in got.collect()) == replay(records, 10, 2)
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    whole = hold_out(df, "species", ["arrival"], 3)
    assert sorted((r.species, r.arrival, r.split) for r in whole.collect()) == replay(records, 10**9, 3)


def test_stream_in_batches_with_a_restart_equals_batch(spark, records, scratch):
    source, out, checkpoint = scratch("in"), scratch("out"), scratch("checkpoint")
    for part in range(5):
        rows = records[part * 60 : part * 60 + 60]
        spark.createDataFrame(rows, "species string, arrival long").coalesce(1).write.mode("append").parquet(source)
        if part in (1, 4):  # two runs: the second one continues
            for i, name in enumerate(sorted((f for f in os.listdir(source) if f.endswith(".parquet")), key=lambda f: os.stat(f"{source}/{f}").st_mtime)):
                os.utime(f"{source}/{name}", (time.time() - 100 + i, time.time() - 100 + i))
            curate_stream(file_stream(spark, source, "species string, arrival long", files_per_batch=1), out, checkpoint, 10, 2)
    got = stream_output(spark, out)
    assert sorted((r.species, r.arrival, r.split) for r in got.collect()) == replay(records, 10, 2)
    assert got.select("batch").distinct().count() <= 5


@pytest.fixture
def quiet_state(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_with_missing_labels_late_records_and_a_crash(spark, scratch, quiet_state):
    """Three batches; labels are missing in each, numbers come late, and the second batch is cut off after it was stored."""
    rng = random.Random(4)
    waves = [[(rng.choice([None, "", "a", "b", "None"]), n) for n in rng.sample(range(k, 600, 3), 70)] for k in (1, 2, 0)]
    source, out, checkpoint = scratch("in"), scratch("out"), scratch("checkpoint")

    def stop(batch):
        if batch == 1:
            raise RuntimeError("cut off")

    for n, wave in enumerate(waves):
        rows = spark.createDataFrame([*wave, ("a", None)], "species string, arrival long")
        rows.repartition(3).write.mode("append").parquet(source)
        if n == 1:
            with pytest.raises(StreamingQueryException):
                curate_stream(file_stream(spark, source, rows.schema), out, checkpoint, 12, 3, on_batch=stop)
        curate_stream(file_stream(spark, source, rows.schema), out, checkpoint, 12, 3)
    expected, count = [], Counter()
    for label, arrival in [r for wave in waves for r in sorted(wave, key=lambda r: r[1])]:
        count[label] += 1
        if count[label] <= 12:
            expected.append((label, arrival, count[label], "val" if count[label] <= 3 else "train"))
    got = [(r.species, r.arrival, r.place, r.split) for r in stream_output(spark, out).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_tasks_pass_on_no_more_than_the_quota(monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), n) for n in rng.sample(range(5000), 1000)]
    batches = [pa.RecordBatch.from_pydict({"species": [r[0] for r in rows[i : i + 100]], "arrival": [r[1] for r in rows[i : i + 100]]}) for i in range(0, 1000, 100)]
    told = [r for b in first_of_each(7)(batches) for r in zip(*b.to_pydict().values(), strict=True)]
    assert len(told) == 21
    assert all(sorted(a for x, a in told if x == label) == sorted(a for x, a in rows if x == label)[:7] for label in ("hot", None, "b"))
    monkeypatch.setattr(keyed, "HELD_ROWS", 10)  # more travel, none is lost
    more = [r for b in first_of_each(7)(batches) for r in zip(*b.to_pydict().values(), strict=True)]
    assert set(told) <= set(more) and len(more) < 300


def test_collection_stops_when_every_label_is_full(spark, scratch):
    rng = random.Random(6)
    records = [(rng.choice("aaaab"), n) for n in range(400)] + [("c", 37), ("c", 350)]
    files = []
    for i in range(20):
        path = scratch(f"f{i:02d}")
        part = spark.createDataFrame([r for r in records if r[1] // 20 == i], "species string, arrival long")
        part.coalesce(1).write.parquet(path)
        files += spark.read.parquet(path).inputFiles()
    # Names within one folder, in the order of arrival.
    target = scratch("all")
    for i, name in enumerate(files):
        move_files(os.path.dirname(name), target, prefix=f"{i:02d}-")
    names = sorted(spark.read.parquet(target).inputFiles())
    for labels, most, read in ((["a", "b"], 3, 4), (["a", "b", "c"], 1, 2), (["a", "b", "c"], 2, 20), (["a", "z"], 1, 20)):
        universe = spark.createDataFrame([(x,) for x in labels], "species string")
        kept, n = collect_until_full(spark, names, "species string, arrival long", universe, most)
        assert n <= read and (n == 20) == (read == 20)
        expected = {(x, a) for x in labels for a in sorted(a for y, a in records if y == x)[:most]}
        assert {(r.species, r.arrival) for r in kept.collect()} == expected
    none, n = collect_until_full(spark, [], "species string, arrival long", universe)
    assert (none.count(), n) == (0, 0)


def test_shards_read_every_file_once(spark, scratch):
    source, out, checkpoint = scratch("in"), scratch("out"), scratch("checkpoint")
    batches = 0
    for part in range(2):
        rows = spark.range(part * 100, part * 100 + 100).repartition(5)
        rows.write.parquet(f"{source}-{part}")
        move_files(f"{source}-{part}", source, prefix=f"{part}-")
        stream = shard_stream(spark, source, "id long", f"{checkpoint}-progress.json", shards=3, files_per_batch=1)
        batches += run_until_read(stream, out, checkpoint)
    got = stream_output(spark, out)
    assert sorted(r.id for r in got.collect()) == list(range(200)) and batches == 4


def test_local_before_remote(spark):
    local = spark.createDataFrame([("a", 9), ("a", 8)], "species string, id int")
    remote = spark.createDataFrame([("a", 1), ("b", 2)], "species string, id int")
    kept = arrival_rank(by_source([local, remote]), "species", ["source_rank", "id"], 2)
    assert sorted((r.species, r.id) for r in kept.collect()) == [("a", 8), ("a", 9), ("b", 2)]


def test_progress_and_coverage(spark):
    universe = spark.createDataFrame([("a",), ("b",)], "species string")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "species string, arrival long")
    kept = curate(rows, "species", ["arrival"], 3, 2)
    assert tuple(collection_progress(kept, universe, 3).first()) == (4, 6, 2, False)
    assert {tuple(r) for r in coverage(universe, kept).collect()} == {("a", 1, False), ("b", 0, True)}


def test_path_rules(spark):
    paths = ["a/B_c/x.PNG", "x.tar.gz", ".png", "a.b/c", "a/b.jpeg", "nodot"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(file_extension(F.col("p")).alias("e"), has_extension(F.col("p")).alias("h"), parent_folder(F.col("p")).alias("f")).collect()
    assert [r.e for r in got] == [".png", ".gz", "", "", ".jpeg", ""]
    assert [r.h for r in got] == [True, False, False, False, True, False]
    assert got[0].f == "B_c" and got[1].f == ""


def test_size_and_exclusive_inputs(spark):
    df = spark.createDataFrame([(10, 50, True), (10, 10, False), (11, 11, True), (9, 50, False)], "w int, h int, l boolean")
    assert [r.ok for r in df.select(is_large_enough(F.col("w"), F.col("h"), F.col("l")).alias("ok")).collect()] == [False, True, True, False]
    both = spark.createDataFrame([("a", None), (None, "b"), ("a", "b"), (None, None)], "a string, b string")
    assert [r.ok for r in both.select(exactly_one(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, True, False, False]


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def test_archives(spark, tmp_path):
    one = archive([("top/Mr_Vole/a.png", "1"), ("root.JPG", "2"), ("notes.txt", "3"), ("top/Mr_Vole/deep/b.webp", "4")])
    two = archive([("Mr Vole/a.png", "5"), ("x/Mr_Vole/a.png", "6")])
    rows = spark.createDataFrame([("1.zip", bytearray(one)), ("2.zip", bytearray(two)), ("3.zip", bytearray(b"broken"))], "path string, content binary")
    got = {(r.label, r.file_name): bytes(r.content) for r in expand_archives(spark, rows).collect()}
    assert got == {
        ("Mr Vole", "a.png"): b"1", ("unknown", "root.JPG"): b"2", ("deep", "b.webp"): b"4",
        ("Mr Vole", "a_1.png"): b"5", ("Mr Vole", "a_2.png"): b"6",
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.ZIP").write_bytes(one)
    assert extract_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 3
    assert (tmp_path / "out" / "Mr_Vole" / "a.png").read_bytes() == b"1"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    for label in ("Mr_Vole", "heron"):
        (root / label).mkdir()
        for i in range(5):
            (root / label / f"{i}.png").write_bytes(_png(f"{label} {i} " * (100 + 30 * i)))
    (root / "heron" / "broken.PNG").write_bytes(b"no picture")
    (root / "heron" / "notes.txt").write_text("x")
    (root / "heron" / "tiny.png").write_bytes(_png("small"))
    return str(root)


def test_image_scans(spark, folder):
    files = scan_image_files(spark, folder)
    assert files.count() == 12 and {r.label for r in files.select("label").distinct().collect()} == {"mr vole", "heron"}
    images = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1]: r.image for r in scan_images(spark, folder).collect()}
    assert len(images) == 12 and images["heron/broken.PNG"] is None
    picture = images["heron/0.png"]
    rgb = to_rgb(picture.height, picture.width, picture.nChannels, bytes(picture.data))
    text = ("heron 0 " * 100).encode()
    assert rgb.reshape(-1)[: len(text)].tobytes() == text


def test_resize():
    flat = np.full((50, 31, 3), 77, dtype=np.uint8)
    assert (resize(flat) == 77).all() and resize(flat).shape == (224, 224, 3)
    same = np.random.default_rng(0).integers(0, 256, (224, 224, 3), dtype=np.uint8)
    assert np.array_equal(resize(same), same)
    weights = resize_weights(448, 224)  # shrinking by two averages four pixels, weights 1 3 3 1
    assert np.allclose(weights[10, 19:23] * 8, [1, 3, 3, 1]) and np.count_nonzero(weights[10]) == 4
    grey = to_rgb(1, 2, 1, bytes([3, 4]))
    assert grey.tolist() == [[[3, 3, 3], [4, 4, 4]]]


def test_augmentation_depends_on_the_seed_only():
    picture = np.random.default_rng(0).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    assert np.array_equal(augment(picture, -5), augment(picture, -5))
    assert not np.array_equal(augment(picture, 1), augment(picture, 2))
    assert augment(picture, 3).shape == picture.shape


def test_embedding_keeps_bad_images_in_place(spark, folder):
    images = scan_images(spark, folder)
    model = random_projection_model(input_values(), 8)
    got = {r.path.rsplit("/", 1)[-1]: r.vec for r in embed_images(images, "path", model, chunk=3).filter("path like '%heron%'").collect()}
    assert got["broken.PNG"] is None and all(v is not None for n, v in got.items() if n != "broken.PNG")
    assert np.linalg.norm(got["0.png"]) == pytest.approx(1, abs=1e-5)
    one = {r.path: r.pixels for r in prepare_images(images, "path", epoch=1).collect()}
    two = {r.path: r.pixels for r in prepare_images(images.repartition(3), "path", epoch=1).collect()}
    assert one == two and len(one) == 11


def test_equal_pictures_are_embedded_once(spark, folder):
    images = scan_images(spark, folder)
    twice = images.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("id", F.concat("path", F.lit("#"), "copy"))
    vectors, cache = embed_pictures(twice, "id", random_projection_model(input_values(), 8))
    got = {r.id: r.vec for r in vectors.collect()}
    single = {r.path: r.vec for r in embed_images(images, "path", random_projection_model(input_values(), 8)).collect()}
    assert got == {f"{p}#{i}": v for p, v in single.items() for i in (0, 1)}
    assert cache.count() == 11  # the broken file has no picture


def onnx_bytes(weights):
    """A model with one matrix product, written field by field (protobuf wire format)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def number(tag, n):
        return varint(tag << 3) + varint(n)

    def block(tag, body):
        body = body.encode() if isinstance(body, str) else body
        return varint(tag << 3 | 2) + varint(len(body)) + body

    def value(name, *dims):
        shape = b"".join(block(1, block(2, d) if isinstance(d, str) else number(1, d)) for d in dims)
        return block(1, name) + block(2, block(1, number(1, 1) + block(2, shape)))

    rows, cols = weights.shape
    node = block(1, "x") + block(1, "w") + block(2, "y") + block(4, "MatMul")
    tensor = number(1, rows) + number(1, cols) + number(2, 1) + block(8, "w") + block(9, weights.astype("<f4").tobytes())
    graph = block(1, node) + block(2, "g") + block(5, tensor) + block(11, value("x", "n", rows)) + block(12, value("y", "n", cols))
    return number(1, 8) + block(7, graph) + block(8, number(2, 17))


def test_onnx_inference(spark, tmp_path):
    weights = np.random.default_rng(1).normal(size=(3, 4)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(onnx_bytes(weights))
    rows = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(20)], "id int, v array<float>")
    got = rows.select("id", embed_features(F.col("v"), 3, onnx_model(str(tmp_path / "m.onnx")), batch=8).alias("e")).collect()
    for r in got:
        assert r.e == pytest.approx((np.array([r.id, 1.0, -2.0]) @ weights).tolist(), abs=1e-4)


def test_dropout_rate_and_scale(spark):
    rows = spark.range(200).select("id", F.array_repeat(F.lit(1.0), 50).alias("v"))
    kept = rows.select(feature_dropout(F.col("v"), F.col("id"), 3, 0.2).alias("v")).collect()
    values = np.array([r.v for r in kept])
    assert set(np.round(np.unique(values), 6)) == {0.0, 1.25} and abs((values == 0).mean() - 0.2) < 0.02


def test_whole_training_job(spark, folder, scratch):
    store = BankStore(spark, scratch("bank"))
    model = random_projection_model(input_values(), 16)
    version, history, progress = run_training(
        store, folder, None, model, scratch("features"), "m", 8, max_per_label=5, epochs=1, batch=4
    )
    assert tuple(progress.first()) == (10, 10, 2, True) and len(history) == 1
    assert (version["rows"], version["model_id"]) == (6, "m")


def test_curate_train_publish(spark, folder, scratch):
    local = local_records(scan_images(spark, folder))
    remote = local.withColumn("species", F.lit("egret")).withColumn("arrival", F.concat(F.lit("r"), "arrival"))
    rows, labels, progress = curate_images(local, remote, max_labels=0, max_per_label=4, val_per_label=1)
    counts = {(r.species, r.split): r["count"] for r in rows.groupBy("species", "split").count().collect()}
    assert counts == {(s, p): n for s in ("heron", "mr vole", "egret") for p, n in (("val", 1), ("train", 3))}
    assert progress.first().complete
    path = scratch("features")
    build_features(rows, random_projection_model(input_values(), 16), path)
    assert read_split_features(spark, path, "train").count() == 9
    store = BankStore(spark, scratch("bank"))
    version, _, history = train_and_publish(store, path, labels, "m", dim=8, epochs=2, batch=4)
    assert (version["rows"], version["dim"], len(history)) == (9, 8, 2)
    assert {r.species for r in store.bank(version).collect()} == {"heron", "mr vole", "egret"}
