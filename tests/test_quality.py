import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbank.operators.head import AdamW, bucket_count, in_order, initial_weights, loss_and_gradient, train_epoch, train_head
from vecbank.operators.quality import (
    class_centroids, cosine_learning_rate, early_stopping, embedding_parity, head_accuracy, require_parity,
    retrieval_accuracy, throughput,
)

COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set(COALESCE, "false")
    yield
    spark.conf.unset(COALESCE)


def replay(scores, patience):
    best, best_epoch, stale = -1.0, 0, 0
    for epoch, score in enumerate(scores, 1):
        if score > best:
            best, best_epoch, stale = score, epoch, 0
        else:
            stale += 1
            if stale >= patience:
                return best, best_epoch, epoch, epoch
    return best, best_epoch, None, len(scores)


def test_early_stopping(spark, many_ranges):
    rng = random.Random(0)
    runs = {r: [round(rng.random() * (1 + e / 30), 2) for e in range(rng.randint(1, 120))] for r in range(12)}
    runs[99] = [float(e) for e in range(300)]  # never stops, and holds most rows
    rows = [(r, e, s) for r, scores in runs.items() for e, s in enumerate(scores, 1)]
    df = spark.createDataFrame(rows, "run int, epoch long, score double").repartition(6)
    got = {r.run: (r.best_score, r.best_epoch, r.stop_epoch, r.epochs_run) for r in early_stopping(df, 5).collect()}
    assert got == {r: replay(scores, 5) for r, scores in runs.items()}


def test_throughput(spark, many_ranges):
    flushes = [(i, 0.5 * i + 0.1 * (i % 3), 8) for i in range(1, 61)]
    got = throughput(spark.createDataFrame(flushes, "seq long, seconds double, items int"), every=25).orderBy("flush").collect()
    assert [(r.flush, r.rows) for r in got] == [(25, 200), (50, 400)]
    at = {i: s for i, s, _ in flushes}
    assert got[1].window_rate == pytest.approx(200 / (at[50] - at[25]))
    assert got[1].lifetime_rate == pytest.approx(400 / at[50])


def test_learning_rate(spark):
    rates = [r.r for r in spark.range(3).select(cosine_learning_rate(F.col("id"), 0.1, 2).alias("r")).collect()]
    assert rates == pytest.approx([0.1, 0.05, 0.0])


def test_parity_gate(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, vec array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.1, 0.9])], "item_id long, vec array<double>")
    stats = embedding_parity(a, b)
    assert tuple(stats.first()) == pytest.approx((2, 0.9, 0.95, 0.1))
    assert require_parity(embedding_parity(a, a)).count() == 1
    with pytest.raises(Exception, match="differ"):
        require_parity(stats).collect()


def test_accuracies(spark):
    rows = spark.createDataFrame(
        [(0, "a", [1.0, 0.0]), (1, "a", [0.9, 0.1]), (2, "b", [0.0, 1.0]), (3, "b", [1.0, 0.05])],
        "row_id long, species string, vec array<double>",
    )
    items = rows.withColumnRenamed("row_id", "query_id")
    assert tuple(head_accuracy(items, class_centroids(rows)).first()) == (4, 75.0)
    assert tuple(retrieval_accuracy(items, rows).first()) == (4, 75.0)  # raw dot products: 1 is nearest to 3
    assert tuple(retrieval_accuracy(items.limit(0), rows).first()) == (0, 0.0)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    w = initial_weights(6, 5, 4, seed=1)
    x, y = rng.normal(size=(7, 6)), rng.integers(0, 4, 7)
    _, _, gradient = loss_and_gradient(w, x, y)
    for name, value in w.items():
        for index in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
            step = np.zeros_like(value)
            step[index] = 1e-6
            up = loss_and_gradient({**w, name: value + step}, x, y)[0]
            down = loss_and_gradient({**w, name: value - step}, x, y)[0]
            assert gradient[name][index] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def blobs(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(3, 8)) * 2
    y = rng.integers(0, 3, n)
    x = centers[y] + rng.normal(size=(n, 8))
    rows = [(int(i), int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, feat array<float>")


@pytest.mark.parametrize("buckets,batch", [(1, 16), (3, 7)])
def test_epoch_averages_local_steps(spark, buckets, batch):
    rows = blobs(spark, 50)
    held = {}
    for r in in_order(rows.coalesce(1), buckets, 4).collect():
        held.setdefault(r.bucket, []).append(r)
    assert len(held) == buckets
    ends, sizes = [], []
    for part in held.values():
        local = AdamW(initial_weights(8, 4, 3))
        for at in range(0, len(part), batch):
            some = part[at : at + batch]
            _, _, gradient = loss_and_gradient(local.weights, np.array([r.feat for r in some]), np.array([r.label for r in some]))
            local.step(gradient, 0.01, 0.01)
        ends.append(local.pack())
        sizes.append(len(part))
    state = AdamW(initial_weights(8, 4, 3))
    got, _, _ = train_epoch(rows.repartition(6), state, 4, 0.01, buckets, batch, dropout=0.0)
    assert state.steps == 0 and got.steps == round(sum(n * -(-n // batch) for n in sizes) / 50)
    assert np.allclose(got.pack(), np.average(ends, axis=0, weights=sizes), atol=1e-12)


def test_jobs_of_an_epoch_do_not_grow_with_rows(spark):
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (60, 1200):
        spark.sparkContext.setJobGroup(f"epoch-{n}", "one epoch")
        train_epoch(blobs(spark, n), AdamW(initial_weights(8, 4, 3)), 0, 0.01, bucket_count(n, 10, 2), 10)
        jobs.append(len(tracker.getJobIdsForGroup(f"epoch-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert bucket_count(1200, 10, 2) == 60 and jobs[0] == jobs[1] > 0


def test_training_does_not_depend_on_partitions(spark):
    rows = blobs(spark)
    histories = [
        train_head(part.filter("id >= 60"), part.filter("id < 60"), 3, dim=4, epochs=3, lr=0.1, batch=20, local_steps=2)[1]
        for part in (rows.coalesce(1), rows.repartition(8), rows.repartition(64))
    ]
    for history in histories[1:]:
        for one, other in zip(histories[0], history, strict=True):
            assert all(abs(one[k] - other[k]) < 1e-6 for k in ("loss", "train_acc", "val_acc", "val_retrieval"))
    assert histories[0][-1]["val_acc"] > 50  # chance is 33


def test_training_learns_and_resumes(spark, scratch):
    rows = blobs(spark).repartition(4)
    train, val = rows.filter("id >= 60"), rows.filter("id < 60")
    path = scratch("state") + ".npz"
    _, first = train_head(train, val, 3, dim=4, epochs=4, lr=0.1, batch=32, state_path=path)
    assert first[-1]["loss"] < first[0]["loss"] and first[-1]["val_retrieval"] > 70
    _, again = train_head(train, val, 3, dim=4, epochs=4, lr=0.1, batch=32, state_path=path)
    assert again == first  # nothing left to do
    _, no_val = train_head(train, val.limit(0), 3, dim=4, epochs=2, lr=0.1, batch=32)
    assert [h["score"] for h in no_val] == [0.0, 1.0] and all(h["improved"] for h in no_val)
