import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbank.functions.vectors import (
    dot, from_base64, from_bytes, from_json_text, half_precision, is_finite, is_usable, l2_normalize, norm, to_base64,
    to_bytes, to_json_text,
)
from vecbank.operators.bank import packed

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [NAN, 1.0]), (3, [INF, 1.0]), (4, [1.0]), (5, None), (6, [1e-8, 0.0])]
    return spark.createDataFrame(data, "id int, vec array<float>")


def test_checks(rows):
    vec = F.col("vec")
    got = {r.id: r for r in rows.select("id", norm(vec).alias("n"), is_finite(vec).alias("f"), is_usable(vec, 2).alias("u")).collect()}
    assert got[0].n == 5.0 and got[1].n == 0.0 and got[5].n is None
    assert [got[i].f for i in range(4)] == [True, True, False, False]
    assert [got[i].u for i in range(7)] == [True, False, False, False, False, False, False]


def test_normalize(rows):
    got = {r.id: r for r in rows.select("id", l2_normalize(F.col("vec")).alias("v"), l2_normalize(F.col("vec"), 1e-9).alias("w")).collect()}
    assert got[0].v == pytest.approx([0.6, 0.8])
    assert got[1].v == [None, None] and got[1].w == [0.0, 0.0]
    assert got[5].v is None
    assert got[6].w == pytest.approx([1.0, 0.0])


def test_normalizing_twice_is_cheap(spark):
    """The norm is computed once per row, also when expressions are nested."""
    data = spark.createDataFrame([(list(map(float, range(1, 400))),)], "vec array<double>")
    vec = l2_normalize(l2_normalize(l2_normalize(F.col("vec"))))
    assert data.select(norm(vec).alias("n")).first().n == pytest.approx(1.0)


def test_dot(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<double>")
    assert row.select(dot(F.col("a"), F.col("b")).alias("d")).first().d == 11.0


def test_codecs(spark):
    vec = np.array([0.1, -2.5, 3e-5], dtype=np.float32)
    text = base64.b64encode(vec.tobytes()).decode()
    rows = spark.createDataFrame([(0, vec.tolist(), text), (1, None, "!!"), (2, [], "AAA=")], "id int, vec array<float>, t string")
    got = rows.select(
        "id", to_bytes(F.col("vec")).alias("b"), to_base64(F.col("vec")).alias("s"),
        from_base64(F.col("t")).alias("v"), from_bytes(to_bytes(F.col("vec"))).alias("back"),
        from_json_text(to_json_text(F.col("vec"))).alias("j"),
    ).orderBy("id").collect()
    assert bytes(got[0].b) == vec.tobytes() and got[0].s == text
    assert got[0].v == vec.tolist() and got[0].back == vec.tolist() and got[0].j == vec.tolist()
    assert got[1].b is None and got[1].v is None and got[2].v is None


def test_broken_json(spark):
    rows = spark.createDataFrame([("[1, 2",), ('["a"]',), ("{}",), ("[]",), ("[1, null]",), ("[1, 2]",)], "t string")
    assert [r.v for r in rows.select(from_json_text(F.col("t")).alias("v")).collect()] == [None] * 5 + [[1.0, 2.0]]


def test_half_precision(spark):
    vec = [0.1, 1.0, 1000.5, math.pi]
    row = spark.createDataFrame([(vec,)], "v array<float>").select(half_precision(F.col("v")).alias("h")).first()
    assert row.h == np.array(vec, dtype=np.float32).astype(np.float16).astype(np.float32).tolist()


def test_packed(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, vec array<double>")
    got = {r.id: np.frombuffer(bytes(r.vec), "<f4").tolist() for r in packed(rows, normalize=True, floor=1e-9, half=True).collect()}
    assert got == {1: np.array([0.6, 0.8]).astype(np.float16).astype(np.float32).tolist(), 2: [0.0, 0.0]}
    nulls = spark.createDataFrame([(1, None), (2, [1.0])], "id int, vec array<float>")
    assert [r.vec is None for r in packed(nulls).orderBy("id").collect()] == [True, False]
