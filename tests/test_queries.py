"""Every registered query against its SQL twin, and what the plans must not contain."""

import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

DUCK = None


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    columns, rows = got.columns, [tuple(r) for r in got.collect()]
    assert len(set(columns)) == len(columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    assert table_of(columns, rows) == table_of([d[0] for d in result.description], result.fetchall())


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "knn_topk_blocked", "near_dup_pairs", "resolve_names", "train_val_split", "quota_hot_label", "forget_by_log",
    "early_stopping", "coverage", "label_counts_upsert", "suggest_names", "bank_versions",
])
def test_no_cross_joins_in_plans(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_quota_is_limited_before_the_shuffle(spark, sf):
    plan = entry.queries()["quota_hot_label"](spark, sf)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial and final


def test_library_avoids_unbounded_operations():
    root = pathlib.Path(entry.__file__).parent / "vecbank"
    text = "\n".join(p.read_text() for p in root.rglob("*.py"))
    for word in ("crossJoin", "localCheckpoint", "toPandas", ".rdd", "@F.udf"):
        assert word not in text
