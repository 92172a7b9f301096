import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbank.functions.admission import content_hash, payload_admission, pixel_hash, url_admission
from vecbank.operators.embedding import embed_features, random_projection_model
from vecbank.operators.serving import counters, embed_distinct, latency_percentiles, ordered_results
from vecbank.session import materialize, shared_dir
from vecbank.streaming.jobs import file_stream
from vecbank.streaming.latency import rolling_latency


@pytest.mark.parametrize("url,verdict", [
    ("https://cdn.allowed.com/a.png", "ok"), ("http://allowed.com", "ok"), ("https://ALLOWED.com:8443/x?y#z", "ok"),
    ("https://notallowed.com/", "host_not_allowed"), ("https://allowed.com.evil.org/", "host_not_allowed"),
    ("https://exact.org/a", "ok"), ("https://sub.exact.org/a", "host_not_allowed"),
    ("ftp://allowed.com/", "bad_url"), ("https://user@allowed.com/", "bad_url"), ("https://:pw@allowed.com/", "bad_url"),
    ("https:///path", "bad_url"), ("allowed.com", "bad_url"), ("", "bad_url"), (None, "bad_url"), ("https://a b.com/", "bad_url"),
    ("https://under_score.allowed.com/", "bad_url"),  # java.net.URI knows no such host
])
def test_url_rules(spark, url, verdict):
    row = spark.createDataFrame([(url,)], "u string").select(url_admission(F.col("u"), (".allowed.com",), ("exact.org",)).alias("v"))
    assert row.first().v == verdict


def test_payloads_and_hashes(spark):
    rows = spark.createDataFrame([(b"",), (b"abc",), (b"abcd",), (None,)], "c binary")
    assert [r.v for r in rows.select(payload_admission(F.col("c"), 3).alias("v")).collect()] == ["empty", "ok", "too_large", "empty"]
    shapes = spark.createDataFrame([(2, 3, b"abcdef"), (3, 2, b"abcdef")], "w int, h int, d binary")
    assert shapes.select(pixel_hash(F.col("w"), F.col("h"), F.col("d"))).distinct().count() == 2


def test_copies_are_embedded_once(spark):
    items = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "id int, text string")
    calls = []

    def embed(rows):
        calls.append(rows.count())
        return rows.select("hash", F.array(F.length("content").cast("double")).alias("vec"))

    joined, cache = embed_distinct(items, "text", content_hash(F.col("text")), embed)
    assert calls == [11] and joined.filter("vec is null").count() == 0 and joined.count() == 30
    more = items.union(spark.createDataFrame([(99, "new")], items.schema))
    joined, cache = embed_distinct(more, "text", content_hash(F.col("text")), embed, materialize(cache, "cache"))
    assert calls == [11, 1] and cache.count() == 12 and joined.filter("vec is null").count() == 0


def test_order_and_counters(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    answers = spark.createDataFrame([(2, "a")], "query_id long, species string")
    rows = ordered_results(asked, answers, ["query_id"])
    assert {r.query_id: (r.species, r.ok) for r in rows.collect()} == {1: (None, False), 2: ("a", True), 3: (None, False)}
    assert tuple(counters(rows).first()) == (1, 2)


def samples(n=900):
    rng = random.Random(1)
    return [("hot" if rng.random() < 0.8 else "cold", i, round(rng.random() * 50, 3)) for i in range(n)]


def expected(rows, window):
    out = {}
    for kind in {k for k, _, _ in rows}:
        last = [m for k, _, m in sorted(rows, key=lambda r: r[1]) if k == kind][-window:]
        out[kind] = (len(last), round(float(np.percentile(last, 50)), 2), round(float(np.percentile(last, 95)), 2))
    return out


def test_percentiles(spark):
    rows = [("a", i, float(x)) for i, x in enumerate((1, 2, 3, 10))]
    got = latency_percentiles(spark.createDataFrame(rows, "kind string, seq long, ms double")).first()
    assert (got.n, got.p50, got.p95) == (4, 2.5, 8.95)


def test_rolling_latency_over_batches(spark, scratch):
    rows = samples()
    source = scratch("samples")
    spark.createDataFrame(rows, "kind string, seq long, ms double").repartition(4).write.parquet(source)
    stream = file_stream(spark, source, "kind string, seq long, ms double", files_per_batch=1)
    got = rolling_latency(stream, scratch("out"), scratch("checkpoint"), window=100, salts=3)
    assert {r.kind: (r.n, r.p50, r.p95) for r in got.collect()} == expected(rows, 100)


def test_feature_inference(spark):
    model = random_projection_model(3, 4, seed=1)
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0])], "id int, v array<float>")
    got = {r.id: r.e for r in rows.select("id", embed_features(F.col("v"), 3, model).alias("e")).collect()}
    assert got[1] == pytest.approx(model()(np.array([[1.0, 2.0, 3.0]]))[0].tolist(), abs=1e-6) and got[2] == [0.0] * 4


class Session:
    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default):
        return self.settings.get(key, default)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="spark://m")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(spark_master="spark://m"))
    assert shared_dir(spark) == shared_dir(spark)


def test_scratch_can_be_dropped(tmp_path):
    import os

    from vecbank.session import drop_scratch, scratch_path

    session = Session(spark_checkpoint_dir=str(tmp_path), spark_app_id="app-1")
    os.makedirs(scratch_path(session, "x"))
    os.makedirs(tmp_path / "vecbank-app-2" / "y")
    drop_scratch(session)
    drop_scratch(session)
    assert os.listdir(tmp_path) == ["vecbank-app-2"]
