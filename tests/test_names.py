import difflib
import random

import pytest
from helpers import canonical, key
from pyspark.sql import functions as F

from vecbank.functions.names import (
    folder_label, is_learned, is_valid_name, name_key, new_name, pick_column, pick_label_and_image, stored_label,
    variant_name,
)
from vecbank.operators.naming import (
    CharacterIndex, cap_labels, close_names, decode_labels, label_universe, name_index, resolve_names, sharing_enough, suggest_names,
)
from vecbank.settings import IMAGE_COLUMNS, LABEL_COLUMNS

NAMES = ["Mr. Vole", "mr_vole", " Finch♀ ", "O'Wren", "KIND: none", "Bébé", "", "  ", "a\tb\n c", "ß X", " padded ", "♂"]


def test_key_and_canonical_match_python(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = rows.select("n", name_key(F.col("n")).alias("k"), new_name(F.col("n")).alias("c")).collect()
    assert {r.n: (r.k, r.c) for r in got} == {n: (key(n), canonical(n)) for n in NAMES}


def test_folder_label_and_validity(spark):
    names = ["_Mr_Vole_", "x" * 64, "x" * 65, "...", "ok", None, "  ok  "]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select(folder_label(F.col("n")).alias("f"), is_valid_name(F.col("n")).alias("v")).collect()
    assert got[0].f == "mr vole"
    assert [r.v for r in got] == [True, True, False, False, True, False, True]


def test_stored_and_variant_names(spark):
    row = spark.range(1).select(
        stored_label(F.lit("é" * 70)).alias("s"), variant_name(F.lit("a"), F.lit(12), F.lit(7)).alias("v")
    ).select("s", "v", is_learned(F.col("v")).alias("l"), is_learned(F.lit("a_base")).alias("b")).first()
    assert row.s == "é" * 64 and row.v.startswith("a__learned_12_") and len(row.v) == len("a__learned_12_") + 8
    assert row.l and not row.b


def test_pick_columns():
    assert pick_column(["id", "name", "label"], LABEL_COLUMNS, 0) == "label"
    assert pick_label_and_image(["id", "species", "img"], LABEL_COLUMNS, IMAGE_COLUMNS) == ("species", "img")
    assert pick_label_and_image(["x", "y"], LABEL_COLUMNS, IMAGE_COLUMNS) == ("x", "y")
    assert pick_label_and_image(["label"], LABEL_COLUMNS, IMAGE_COLUMNS) == ("label", "label")


def test_name_collision_takes_the_first_row(spark):
    bank = spark.createDataFrame([(5, "Mr. Vole"), (2, "mr_vole"), (1, "heron"), (9, "...")], "row_id long, species string")
    index = name_index(bank)
    assert {(r.key, r.species) for r in index.collect()} == {("mrvole", "mr_vole"), ("heron", "heron")}
    asked = spark.createDataFrame([("MR VOLE",), ("???",), ("Heron!",), ("egret",)], "name string")
    found = {r["name"]: r.species for r in resolve_names(asked, index).collect()}
    assert found == {"MR VOLE": "mr_vole", "???": None, "Heron!": "heron", "egret": None}


def test_universe_and_cap(spark):
    local = spark.createDataFrame([("b",), ("d",), ("",)], "species string")
    remote = spark.createDataFrame([("a",), ("b",), ("c",)], "species string")
    universe = label_universe(local, remote)
    assert [(r.species, r.idx, r.is_local) for r in universe.orderBy("idx").collect()] == [
        ("a", 0, False), ("b", 1, True), ("c", 2, False), ("d", 3, True)
    ]
    assert [(r.species, r.idx) for r in cap_labels(universe, 3).orderBy("idx").collect()] == [("b", 0), ("d", 1), ("a", 2)]
    assert cap_labels(universe, 0).count() == 4
    codes = spark.createDataFrame([(0,), (7,)], "idx long")
    assert sorted(r.species for r in decode_labels(codes, universe, "idx").collect()) == ["a", "unknown"]


def test_ties_come_in_descending_name_order():
    assert [x[1] for x in close_names(["abcd"], ["abce", "abcf", "abcg", "zzzz"], 2, 0.6)] == ["abcg", "abcf"]


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_suggestions_equal_difflib(spark, block_rows):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé_") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    labels = sorted(set(words[:80]))
    asked = [w[:-1] + rng.choice("abz") for w in words]
    got = suggest_names(
        spark.createDataFrame([(a,) for a in asked], "name string"),
        spark.createDataFrame([(x,) for x in labels], "species string"),
        block_rows=block_rows,
    )
    found = {r.word: r.suggestions for r in got.collect()}
    for name in asked:
        assert found.get(canonical(name), []) == difflib.get_close_matches(canonical(name), labels, n=3, cutoff=0.6)


def test_index_of_characters_loses_no_pair():
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("aabcdeé_") for _ in range(rng.randint(1, 16))) for _ in range(160)})
    common = {"a1 ": 90, "b1 ": 40, "e1 ": 40}
    index = CharacterIndex(common, 0.6)
    lengths = sorted({len(n) for n in names})
    keys = {n: (set(index.keys(n, lengths, True)), set(index.keys(n, lengths, False))) for n in names}
    for word in names:
        near = set(dict(sharing_enough([word], names, 0.6))[word])
        for label in names:
            shared = keys[word][0] & keys[label][1]
            assert shared or label not in near
            assert sum(index.meets_here(k, word, label) for k in shared) == bool(shared)
    assert max(len(k) for pair in keys.values() for k in pair) < 60 * len(lengths)
