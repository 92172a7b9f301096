"""Hard-negative mining against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbank.llm import negatives

SCHEMA = "vec_id long, label int, vec array<double>, score string, windows int, s int, nth int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def brute(rows, chosen, scale, positives, negatives_, low, high):
    width = max(len(v) for _, _, v in rows)
    whole = [(i, y, np.floor(scale * np.pad(np.array(v, float), (0, width - len(v))))) for i, y, v in rows]
    out = []
    for i, y, q in whole:
        if not chosen(i):
            continue
        scored = sorted((-int(q @ v), j, z) for j, z, v in whole if j != i)
        for s, j, _ in [h for h in scored if h[2] == y][:positives]:
            fits = [(t, n) for t, n, z in scored if z != y and low * -s <= 100 * -t <= 100 * high // 100 * -s]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits[:negatives_], 1)]
    return sorted(out)


def clustered(seed, n=600, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    vecs = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, width))
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(vecs)]
    rows += [(n + i, int(rng.integers(0, 3)), rows[0][2]) for i in range(150)]  # one very common vector
    return rows + [(2000, 7, rows[0][2]), (2001, 8, [0.0] * width), (2002, 1, [0.5]), (2003, 2, [])]


@pytest.mark.parametrize("share", [negatives.SHARE, 64])
def test_mining_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(negatives, "SHARE", share)
    monkeypatch.setattr(negatives, "GROUP", 1 << 17 if share > 64 else 20)
    rows = clustered(1)
    odd = [(3000, None, [1.0] * 12), (3001, 1, None), (3002, 1, [None] * 12), (3003, 1, [float("nan")] * 12), (3004, 1, [float("inf")] * 12), (None, 1, [1.0] * 12)]
    every = table(spark, rows + odd)
    got = negatives.mine(every.filter("vec_id % 40 = 0 or vec_id >= 2000"), every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 40 == 0 or i >= 2000, 256, 5, 5, 80, 100)


def test_other_sizes_and_repeated_rows(spark):
    rows = clustered(2, n=120)
    doubled = table(spark, rows + rows[:50])
    got = negatives.mine(doubled.filter(F.col("vec_id") % 7 == 0), doubled, scale=100, positives=2, negatives=9, low=50, high=90)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 7 == 0, 100, 2, 9, 50, 90)
    assert negatives.mine(doubled.limit(0), doubled).collect() == [] == negatives.mine(doubled, doubled.limit(0)).collect()
    with pytest.raises(ValueError, match="exact"):
        negatives.mine(huge := table(spark, [(1, 1, [1e30]), (2, 1, [1e30])]), huge)


def test_tree_covers_its_points_and_finds_all():
    rows = clustered(3)[:-3]
    ids, labels, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.floor(256 * np.array([r[2] for r in rows]))
    tree = negatives.CoverTree(ids, labels, matrix, leaf=4)
    assert sorted(tree.ids.tolist()) == sorted(ids.tolist()) and tree.child.max() > 50
    for n in range(len(tree.first)):
        own = slice(tree.first[n], tree.end[n])
        assert np.sqrt(((tree.matrix[own] - tree.centres[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-9
        assert (tree.low_label[n], tree.high_label[n]) == (tree.labels[own].min(), tree.labels[own].max())
        a, b = tree.child[n]
        if b > a:  # children split the run of their parent
            assert tree.first[a] == tree.first[n] and tree.end[b - 1] == tree.end[n] and (tree.first[a + 1 : b] == tree.end[a : b - 1]).all()
            assert (tree.radius[a:b] <= tree.radius[n] / 2 * (1 + 1e-8)).all()
    lookups = defaultdict(int)
    original = negatives.spread
    negatives.spread = lambda first, end: (lookups.__setitem__("points", lookups["points"] + len(out := original(first, end))), out)[1]
    try:
        score = matrix @ matrix[5]
        found, _ = tree.best(-1, matrix[5], 0, True, -np.inf, np.inf, 5)
    finally:
        negatives.spread = original
    fit = np.flatnonzero(labels == 0)
    assert sorted(found.tolist()) == sorted(ids[fit[np.lexsort((ids[fit], -score[fit]))[:5]]].tolist())
    assert lookups["points"] < len(ids) + len(tree.first)  # parts of the tree were left out
