import numpy as np
import pytest
from helpers import brute_learn, shuffled_rows, unit
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vecbank.operators.learn import learn, max_similarity, pair_batch, reject_near_duplicates
from vecbank.plans.teach import teach
from vecbank.sources.store import BankStore
from vecbank.streaming import keyed
from vecbank.streaming.jobs import file_stream, stream_output, teach_stream

DIM = 4
X = [1.0, 0.0, 0.0, 0.0]
REQUEST = "seq long, name string, vec array<double>, allow_new boolean"


def chain(n, step=0.06, seed=0):
    """Vectors on arcs, so that neighbours are near duplicates and two steps are not."""
    rng = np.random.default_rng(seed)
    arcs = rng.integers(0, 3, n)
    at = rng.integers(0, 25, n) * step
    out = np.zeros((n, DIM))
    out[:, 0], out[:, 1] = np.cos(at), np.sin(at)
    out[np.arange(n), arcs % 2 + 2] += 0.4 * (arcs - 1)
    return unit(out) * rng.uniform(0.5, 2, (n, 1))


def scenario(n=160, seed=0):
    rng = np.random.default_rng(seed)
    vectors = chain(n, seed=seed)
    names = ["heron", "Heron!", "He-ron", "mr. vole", "Mr Vole", "new one", "New_One", "other", "???", "x" * 65, " "]
    weights = np.array([6, 3, 3, 2, 2, 4, 4, 2, 0.3, 0.3, 0.3])
    picks = rng.choice(len(names), n, p=weights / weights.sum())
    requests = []
    for i in range(n):
        vec = vectors[i].tolist()
        if rng.random() < 0.05:
            vec = [[0.0] * DIM, [float("nan")] + [1.0] * (DIM - 1), [1.0] * (DIM - 1), None, [float("inf")] * DIM][rng.integers(5)]
        requests.append((i * 3, names[picks[i]], vec, bool(rng.random() < 0.6)))
    bank = [("Heron", v) for v in unit(chain(4, seed=9))] + [("mr_vole", v) for v in unit(chain(2, seed=8))] + [("Mr. Vole", [1, 0, 0, 0])]
    return bank, requests


def frames(spark, bank, requests):
    rows = [(i, s, [float(x) for x in v]) for i, (s, v) in enumerate(bank)]
    return (
        spark.createDataFrame(rows, "row_id long, species string, vec array<double>"),
        spark.createDataFrame(requests, REQUEST).repartition(5),
    )


def as_tuples(results):
    return [(r.seq, r.status, r.species, r.examples, r.suggestions) for r in results.orderBy("seq").collect()]


@pytest.mark.parametrize("seed,head_rows,block_rows", [(0, 2048, 4096), (1, 3, 5), (2, 7, 16)])
def test_equals_one_by_one(spark, seed, head_rows, block_rows):
    bank, requests = scenario(seed=seed)
    results, learned = learn(
        *frames(spark, bank, requests), DIM, head_rows=head_rows, block_rows=block_rows, with_suggestions=True
    )
    expected = brute_learn(bank, requests, DIM)
    assert as_tuples(results) == expected
    assert {r.seq for r in learned.collect()} == {e[0] for e in expected if e[1] == "learned"}
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in learned.collect())


def test_copies_are_collapsed_before_the_rounds(spark):
    """A third of all items are one vector; heads of two rows still finish."""
    vec = unit([1.0, 2.0, 3.0, 4.0]).tolist()
    other = unit(np.random.default_rng(0).normal(size=(20, DIM))).tolist()
    rows = [(i, "a", vec) for i in range(100)] + [(100 + i, "a", v) for i, v in enumerate(other)]
    items = spark.createDataFrame(rows, "item_id long, species string, vec array<double>")
    kept = {r.item_id for r in reject_near_duplicates(items, head_rows=2, block_rows=8).collect()}
    expected = {seq for seq, status, *_ in brute_learn([("a", [0, 0, 0, 0])], [(i, "a", v, False) for i, _, v in rows], DIM) if status == "learned"}
    assert kept == expected


def test_rounds_across_blocks_equal_one_by_one(spark):
    """Rounds of two, four and more items; both sides in several blocks; two species."""
    vectors = chain(150, seed=4)
    rows = [(i * 2, "ab"[i % 2], unit(v).tolist()) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "item_id long, species string, vec array<double>")
    for block_rows in (3, 64):
        kept = {r.item_id for r in reject_near_duplicates(items, head_rows=2, block_rows=block_rows).collect()}
        asked = [(i, s, v, False) for i, s, v in rows]
        far = [("a", [0, 0, 0, 0]), ("b", [0, 0, 0, 0])]
        assert kept == {seq for seq, status, *_ in brute_learn(far, asked, DIM) if status == "learned"}


def test_rows_of_one_label_are_not_copied_for_every_few_thousand(spark):
    """10,000 items against 10,000 rows of a label meet in one block (9 blocks and 60,000 rows to deal out before)."""
    vec = F.array(F.cos("id"), F.sin("id"))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit("a").alias("species"), vec.alias("vec"))
    rows = spark.range(10_000).select(F.col("id").alias("row_id"), F.lit("a").alias("species"), vec.alias("vec"))
    best = max_similarity(items, rows)
    assert best.filter("max_sim > 0.999999999").count() == 10_000
    best.collect()
    assert 20_000 < shuffled_rows(best._jdf.queryExecution().executedPlan()) < 35_000


def test_new_species_is_not_checked_and_founder_spells_it(spark):
    bank, requests = [("heron", [1, 0, 0, 0])], [(1, "New  One", X, True), (2, "new one!", X, False)]
    results, _ = learn(*frames(spark, bank, requests), DIM)
    assert as_tuples(results) == [(1, "learned", "new_one", 1, []), (2, "duplicate", "new_one", None, [])]


def test_empty_bank(spark):
    bank, requests = frames(spark, [("a", [1, 0, 0, 0])], [(1, "a", X, True), (2, "a", X, True)])
    results, _ = learn(bank.limit(0), requests, DIM)
    assert [r[1] for r in as_tuples(results)] == ["learned", "duplicate"]


def test_batches_and_stream_equal_one_by_one(spark, scratch):
    bank, requests = scenario(n=90, seed=5)
    rows, asked = frames(spark, bank, requests)
    expected = [e[:4] for e in brute_learn(bank, requests, DIM)]

    def store():
        made = BankStore(spark, scratch("bank"))
        made.publish(rows, "m", DIM, dtype="fp32", normalize=False)
        return made

    one = store()
    for batch in range(3):
        part = asked.filter((F.col("seq") >= batch * 90) & (F.col("seq") < batch * 90 + 90))
        got = as_tuples(teach(one, part, batch=batch))
        assert [g[:4] for g in got] == [e for e in expected if batch * 90 <= e[0] < batch * 90 + 90]
    n_learned = sum(e[1] == "learned" for e in expected)
    assert one.active()["version"] == 1 + n_learned and one.active()["generation"] == 1

    two, out, source, checkpoint = store(), scratch("out"), scratch("in"), scratch("checkpoint")
    schema = asked.schema
    for batch in range(2):  # the second run resumes from the checkpoint
        part = asked.filter((F.col("seq") >= batch * 150) & (F.col("seq") < batch * 150 + 150))
        part.coalesce(1).write.mode("append").parquet(source)
        teach_stream(two, file_stream(spark, source, schema), out, checkpoint)
    assert [t[:4] for t in as_tuples(stream_output(spark, out))] == expected
    assert two.active()["last_batch"] == 1


@pytest.mark.parametrize("seed", [5, 6])
def test_stream_with_keyed_state_equals_one_by_one(spark, scratch, seed):
    """Three runs; only the first one is given the bank, and the second is cut off after its batch was stored."""
    bank, requests = scenario(n=90, seed=seed)
    rows, asked = frames(spark, bank, requests)
    expected = [e[:4] for e in brute_learn(bank, requests, DIM)]
    out, source, checkpoint = scratch("out"), scratch("in"), scratch("checkpoint")

    def stop(batch):
        raise RuntimeError("cut off")

    for run in range(3):
        part = asked.filter((F.col("seq") >= run * 90) & (F.col("seq") < run * 90 + 90))
        part.repartition(2).write.mode("append").parquet(source)
        stream = file_stream(spark, source, asked.schema)
        known = rows if run == 0 else rows.limit(0)
        if run == 1:
            with pytest.raises(StreamingQueryException):
                keyed.learn_stream(stream, known, out, checkpoint, DIM, on_batch=stop)
        keyed.learn_stream(stream, known, out, checkpoint, DIM)
    got = stream_output(spark, out).orderBy("seq").collect()
    assert [(r.seq, r.status, r.species, r.examples) for r in got] == expected
    assert all((r.vec is not None) == (r.status == "learned") for r in got)


def test_pair_batch(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "id int, names array<string>, items array<string>")
    assert [(r.pos, r["name"], r.item) for r in pair_batch(rows, "names", "items").collect()] == [(0, "a", "x"), (1, "b", "y")]
    for names, items in ((["a"], []), ([], []), (["a"] * 65, ["x"] * 65)):
        bad = spark.createDataFrame([(1, names, items)], rows.schema)
        with pytest.raises(Exception, match="length|no items|at most"):
            pair_batch(bad, "names", "items", 64).collect()
