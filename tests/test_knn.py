import numpy as np
import pytest
from helpers import brute_topk, brute_vote, shuffled_rows, unit

from vecbank.operators.bank import packed
from vecbank.operators.knn import Cells, PivotTree, knn
from vecbank.operators.vote import confident_only, publish_prediction, vote
from vecbank.plans.identify import EmptyBank, identify

VEC = "array<double>"


def frames(spark, queries, bank, parts=5):
    q = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in queries], f"query_id long, vec {VEC}")
    b = spark.createDataFrame([(int(r), s, [float(x) for x in v]) for r, s, v in bank], f"row_id long, species string, vec {VEC}")
    return q.repartition(3), b.repartition(parts)


def clustered(n, n_queries, dim=6, seed=0):
    """Labelled vectors in clusters, a third of them copies of one vector, queries of different lengths."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    labels = rng.integers(0, 5, n)
    vectors = unit(centers[labels] + 0.2 * rng.normal(size=(n, dim)))
    vectors[: n // 3] = vectors[0]
    bank = [(i, f"s{labels[i]}", vectors[i]) for i in rng.permutation(n)]
    queries = [(i, rng.uniform(0.5, 2) * (centers[rng.integers(5)] + 0.3 * rng.normal(size=dim))) for i in range(n_queries)]
    return queries + [(n_queries, vectors[0])], bank


def collected(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.row_id, r.species, r.sim))
    return out


@pytest.mark.parametrize("options", [
    {}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "block_rows": 17}, {"broadcast_rows": 0, "block_rows": 64},
    {"broadcast_rows": 40}, {"broadcast_rows": 0, "block_rows": 5, "pivots": 4},
])
@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(spark, options, k):
    queries, bank = clustered(300, 40)
    got = collected(knn(*frames(spark, queries, bank), k=k, **options))
    expected = brute_topk(queries, bank, k)
    assert got.keys() == expected.keys()
    for q, hits in expected.items():
        assert [h[:2] for h in got[q]] == [h[:2] for h in hits]
        assert [h[2] for h in got[q]] == pytest.approx([h[2] for h in hits], abs=1e-11)


def test_two_levels_of_pivots():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 4))
    sample = np.concatenate([rows[:60], rows[:5]])  # with copies
    tree = PivotTree(sample, 7)
    assert (len(tree.tops), len(tree.leaves)) == (7, 60) and tree.first[-1] == 60
    cell = tree.assign(rows)
    top = ((rows[:, None, :] - tree.tops) ** 2).sum(axis=2).argmin(axis=1)
    for i in range(len(rows)):
        own = slice(tree.first[top[i]], tree.first[top[i] + 1])
        assert cell[i] == own.start + ((tree.leaves[own] - rows[i]) ** 2).sum(axis=1).argmin()
    alone = PivotTree(np.zeros((1, 4)), 7)
    assert (alone.assign(rows) == 0).all()


def test_small_bank_null_vectors_and_packed(spark):
    bank = [(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])]
    q, b = frames(spark, [(1, [1.0, 0.5])], bank)
    q = q.union(spark.createDataFrame([(2, None)], q.schema))
    expected = {1: [(0, "a", 1.0), (1, "b", 0.5)]}
    assert collected(knn(q, b, k=5)) == expected
    assert collected(knn(q, packed(b), k=5)) == expected
    assert collected(knn(q, packed(b), k=5, broadcast_rows=0)) == expected
    assert knn(q.filter("query_id = 2"), b).count() == 0


def test_nobody_divides_by_norms(spark):
    q, b = frames(spark, [(1, [2.0, 0.0])], [(0, "a", [3.0, 0.0])])
    assert collected(knn(q, b)) == {1: [(0, "a", 6.0)]}


def test_blocks_prune_and_group_limit_is_planned(spark):
    queries, bank = clustered(300, 10)
    plan = knn(*frames(spark, queries, bank), broadcast_rows=0, block_rows=32)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("shard_values", [1, 6 * 20, 6 * 90])
def test_shards(spark, shard_values):
    """Cells that share a shard and a cell of copies that spans several."""
    queries, bank = clustered(300, 40, seed=2)
    got = collected(knn(*frames(spark, queries, bank), k=4, broadcast_rows=0, block_rows=9, pivots=5, shard_values=shard_values))
    expected = brute_topk(queries, bank, 4)
    assert {q: [h[:2] for h in hits] for q, hits in got.items()} == {q: [h[:2] for h in hits] for q, hits in expected.items()}


def test_cells_are_dealt_to_bounded_shards():
    cells = Cells.dealt(PivotTree(np.arange(7.0)[:, None], 7), np.ones(7), np.array([3, 3, 0, 25, 4, 6, 2]), 10)
    assert cells.slot_shard.tolist() == [0, 0, 1, 2, 3, 4, 4, 5] and cells.slot_cell.tolist() == [0, 1, 3, 3, 3, 4, 5, 6]
    assert cells.shard_rows.tolist() == [6, 9, 9, 9, 10, 2] and cells.parts.tolist() == [1, 1, 1, 3, 1, 1, 1]
    seen = np.zeros((2, 7), bool)
    seen[0, 3] = seen[1, 5] = True
    assert cells.shards_seen(seen).tolist() == [[False, True, True, True, False, False], [False, False, False, False, True, False]]


def test_a_query_travels_once_to_a_shard(spark):
    """Without clusters every cell is looked at; that must not copy a query to each of them."""
    rng = np.random.default_rng(5)
    bank = [(i, "a", v) for i, v in enumerate(unit(rng.normal(size=(400, 16))))]
    queries = list(enumerate(unit(rng.normal(size=(100, 16)))))
    hits = knn(*frames(spark, queries, bank), broadcast_rows=0, block_rows=4)
    assert len(hits.collect()) == 500
    moved = shuffled_rows(hits._jdf.queryExecution().executedPlan())
    assert 500 < moved <= 2 * (100 + 400) + 500 + 500  # the inputs of frames(), both sides, hits


def test_missing_ids_on_the_path_of_many_queries(spark):
    q, b = frames(spark, [(1, [1.0, 0.0])], [(1, "b", [1.0, 0.0]), (2, "c", [0.0, 1.0])])
    q, b = (x.union(spark.createDataFrame([t], x.schema)) for x, t in ((q, (None, [0.0, 1.0])), (b, (None, "a", [1.0, 0.0]))))
    rows = knn(q, b, k=2, broadcast_rows=0).collect()
    assert {(r.query_id, r.rank, r.row_id, r.species) for r in rows} == {
        (1, 1, None, "a"), (1, 2, 1, "b"), (None, 1, 2, "c"), (None, 2, None, "a"),
    }


def hits_frame(spark, lists):
    rows = [(q, i, s, x, i + 1) for q, hits in lists.items() for i, (s, x) in enumerate(hits)]
    return spark.createDataFrame(rows, "query_id long, row_id long, species string, sim double, rank int")


def test_vote_rules(spark):
    lists = {
        1: [("a", 0.9), ("b", 0.8), ("b", 0.7)],  # most votes
        2: [("a", 0.96), ("b", 0.8), ("b", 0.7)],  # near-exact overrules
        3: [("a", 0.9), ("b", 0.8)],  # equal votes: best similarity
        4: [("b", 0.9), ("a", 0.9)],  # full tie: met first
        5: [("b", 0.97), ("b", 0.1), ("a", 0.9)],
    }
    for near_exact in (0.95, None):
        got = {r.query_id: (r.species, r.score) for r in vote(hits_frame(spark, lists), near_exact).collect()}
        expected = {q: brute_vote([(0, s, x) for s, x in hits], near_exact) for q, hits in lists.items()}
        assert got == expected
    voted = vote(hits_frame(spark, lists))
    assert [(n.species, n.score) for n in voted.filter("query_id = 1").first().neighbors] == lists[1]


def test_confidence_compares_before_rounding(spark):
    hits = hits_frame(spark, {1: [("a", 0.4999999)], 2: [("a", 0.5)]})
    rows = {r.query_id: r for r in publish_prediction(vote(hits)).collect()}
    assert rows[1].score == 0.5 and not rows[1].confident and rows[2].confident
    assert [r.query_id for r in confident_only(vote(hits)).collect()] == [2]


def test_identify_keeps_places_and_needs_a_bank(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], f"query_id long, vec {VEC}")
    bank = spark.createDataFrame([(0, "a", [1.0, 0.0])], f"row_id long, species string, vec {VEC}")
    got = {r.query_id: (r.ok, r.species) for r in identify(q, bank).collect()}
    assert got == {1: (True, "a"), 2: (False, None), 3: (False, None), 4: (False, None)}
    empty = bank.limit(0)
    with pytest.raises(EmptyBank):
        identify(q, empty)
    assert identify(q.filter("query_id > 1"), empty).filter("ok").count() == 0


def test_random_votes_match_brute_force(spark):
    queries, bank = clustered(200, 60, seed=4)
    q, b = frames(spark, queries, bank)
    got = {r.query_id: (r.species, r.score) for r in vote(knn(q, b, k=7), 0.95).collect()}
    for q_id, hits in brute_topk(queries, bank, 7).items():
        species, score = brute_vote(hits, 0.95)
        assert got[q_id][0] == species and got[q_id][1] == pytest.approx(score, abs=1e-9)
