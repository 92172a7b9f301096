import random

import pytest
from pyspark.sql import functions as F

from vecbank.operators.bank import (
    bank_stats, bank_union, combine_blocks, extend_blocks, fingerprint_blocks, join_positions, packed, row_hash,
    row_verdict, usable_rows,
)
from vecbank.operators.changes import removal_summary, surviving, upsert_counts, versions

COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set(COALESCE, "false")
    yield
    spark.conf.unset(COALESCE)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(2)
    names = ["hot"] * 5 + ["a", "B!", "b"]
    return [(i, rng.choice(["learn", "learn", "learn", "forget", "reload"]), rng.choice(names)) for i in range(400)]


def replay(log):
    """State after every change: learned rows as [(seq, key)], version, generation."""
    rows, version, generation, out = [], 0, 0, []
    for seq, op, name in log:
        key = name.lower().strip("!")
        if op == "learn":
            rows, version = rows + [(seq, key)], version + 1
        elif op == "reload":
            version, generation = version + 1, generation + 1
        elif any(k == key for _, k in rows):
            rows = [r for r in rows if r[1] != key]
            version, generation = version + 1, generation + 1
        out.append((seq, version, generation))
    return rows, out


def test_versions_and_survivors(spark, log):
    df = spark.createDataFrame(log, "seq long, op string, species string").repartition(5)
    rows, steps = replay(log)
    got = versions(df).select("seq", "version", "generation").orderBy("seq").collect()
    assert [tuple(r) for r in got] == steps
    assert sorted(r.seq for r in surviving(df).collect()) == sorted(s for s, _ in rows)


def test_counts_never_fall_below_zero(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 1)], "species string, count long")
    changes = spark.createDataFrame([("a", 1), ("b", -1), ("b", -1), ("c", 1)], "species string, delta int")
    assert {r["species"]: r["count"] for r in upsert_counts(counts, changes).collect()} == {"a": 3, "b": 0, "c": 1}


def test_removal_summary(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "species string")
    assert tuple(removal_summary(rows).first()) == (3, ["a", "b"])
    assert tuple(removal_summary(rows.limit(0)).first()) == (0, [])


def test_union_puts_base_rows_first(spark):
    base = spark.createDataFrame([(i, "b", [1.0]) for i in range(5)], "row_id long, species string, vec array<float>")
    learned = spark.createDataFrame([(s, "l", [2.0]) for s in (90, 7, 30)], "seq long, species string, vec array<float>")
    rows = bank_union(base, learned).orderBy("row_id").collect()
    assert [(r.row_id, r.origin) for r in rows] == [(i, "base") for i in range(5)] + [(5 + s, "learned") for s in (7, 30, 90)]
    stats = bank_stats(bank_union(base, learned)).first()
    assert tuple(stats) == (8, 2, 3, 1, False)


def test_positions_must_agree(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, species string")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row_id long, vec array<float>")
    assert join_positions(labels, vectors).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        join_positions(labels, vectors.filter("row_id = 0")).collect()


def test_verdicts(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 0.0]), (3, [1.0]), (4, None)], "row_id long, vec array<float>"
    )
    got = {r.row_id: r.v for r in rows.select("row_id", row_verdict(F.col("vec"), 2).alias("v")).collect()}
    assert got == {0: "ok", 1: "zero", 2: "not_finite", 3: "wrong_dim", 4: "wrong_dim"}
    assert [r.row_id for r in usable_rows(rows, 2).collect()] == [0]


def test_fingerprint_depends_on_content_only(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", [float(i), 1.0]) for i in range(50)], "row_id long, species string, vec array<float>")

    def hashed(df):
        return packed(df).select("row_id", row_hash(F.col("species"), F.col("vec")).alias("row_hash"))

    def fingerprint(df, block):
        return combine_blocks(fingerprint_blocks(hashed(df), block), "m", block).first().fingerprint

    whole = fingerprint(rows.repartition(7), 4)  # three levels of blocks
    assert whole == fingerprint(rows.repartition(2), 4) and len(whole) == 16
    assert whole != fingerprint(rows.withColumn("species", F.lit("x")), 4)
    assert whole != combine_blocks(fingerprint_blocks(hashed(rows), 4), "other", 4).first().fingerprint
    stored = fingerprint_blocks(hashed(rows.filter("row_id < 30")), 4)
    grown = extend_blocks(stored, hashed(rows), 4)
    assert combine_blocks(grown, "m", 4).first().fingerprint == whole
