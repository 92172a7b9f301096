import random

import pytest
from pyspark.sql import functions as F

from vecbank.operators.ordered import chunked, numbered, previous_value, running_totals, stride_sample


COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small test data would end up in one range."""
    spark.conf.set(COALESCE, "false")
    yield
    spark.conf.unset(COALESCE)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(-3, 5)) for i in range(500)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "seq long, key string, x long").repartition(6)


def test_running_totals(log):
    rows, df = log
    expected, sums, total = {}, {}, 0
    for seq, key, x in sorted(rows):
        sums[key] = sums.get(key, 0) + x
        total += x
        expected[seq] = (sums[key], total)
    keyed = {r.seq: r.s for r in running_totals(df, ["seq"], ["key"], s=F.col("x")).collect()}
    whole = {r.seq: r.s for r in running_totals(df, ["seq"], s=F.col("x")).collect()}
    assert {s: (keyed[s], whole[s]) for s in keyed} == expected


def test_numbered_chunked_and_stride(log):
    rows, df = log
    assert {r.seq: r.n for r in numbered(df, ["seq"]).collect()} == {i: i + 1 for i in range(500)}
    assert all(r.chunk == r.seq // 7 and r.slot == r.seq % 7 for r in chunked(df, ["seq"], 7).collect())
    for limit in (24, 500, 9999):
        step = max(1, 500 // limit)
        assert sorted(r.seq for r in stride_sample(df, ["seq"], limit).collect()) == list(range(500))[::step][:limit]


def test_previous_value(log):
    rows, df = log
    last, expected = {}, {}
    for seq, key, x in sorted(rows):
        expected[seq] = last.get(key)
        last[key] = x
    assert {r.seq: r.p for r in previous_value(df, ["seq"], ["key"], "x", "p").collect()} == expected


def test_a_hot_key_spans_ranges(log):
    from vecbank.operators.ordered import OrderedRanges

    _, df = log
    ranges = OrderedRanges(df, ["seq"], ["key"])
    assert ranges.rows.filter("key = 'hot'").select("_range").distinct().count() > 1


def test_missing_keys_are_a_key_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "seq long, key string").repartition(4)
    got = {r.seq: (r.n, r.before) for r in previous_value(numbered(df, ["seq"], ["key"]), ["seq"], ["key"], "seq", "before").collect()}
    assert got == {i: (i // 2 + 1, i - 2 if i > 1 else None) for i in range(40)}
