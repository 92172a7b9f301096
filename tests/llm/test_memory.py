"""What Python workers hold: one stage's memory at a time, small buffers, texts that travel once."""

import tracemalloc

import numpy as np
from brute import awkward, data, frame
from pyspark.sql import functions as F

from vecbank.llm import anchors, quality
from vecbank.llm.tokens import encoder


def held_bytes(run) -> tuple[int, int]:
    """Bytes still held after ``run``, and the most at any time."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_words_of_one_stage_go_with_the_next():
    one, other = (b" ".join(b"%s%d" % (name, i) for i in range(50_000)) for name in (b"one", b"other"))
    words, _ = held_bytes(lambda: anchors.word_symbols([one]))

    def stages():
        anchors.word_symbols([other])
        anchors.byte_symbols([other])

    left, _ = held_bytes(stages)
    assert left < words / 10


def test_an_encoder_goes_with_the_next_stage_and_stays_within_one():
    first = encoder()
    ids = first.encode(["some words, some more"])
    assert encoder() is first
    anchors.word_symbols([b"another stage"])
    assert encoder() is not first and encoder().encode(["some words, some more"]) == ids


def test_stretches_of_large_texts_are_found_in_little_memory():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 256, 4 << 20).astype(np.uint8).tobytes()
    anchors.POWERS.upto(2 * anchors.SLICE)

    def run():
        for _, _, held in anchors.buffers(enumerate(anchors.byte_symbols([text])), 200):
            anchors.stretch(held, 200, 32)

    _, most = held_bytes(run)
    assert most < 48 << 20


def test_a_scored_text_travels_once(spark):
    docs = frame(spark, awkward())
    network = quality.Network(1)
    scored = quality.score(docs, network)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "as binary" not in plan and "__text" not in plan
    # Texts of another type, and those that are not carried along, come as bytes.
    for other in (docs.withColumn("text", F.col("text").cast("binary")), docs.withColumnRenamed("text", "TEXT")):
        assert scores_of(quality.score(other, network)) == scores_of(scored)
    got = scores_of(scored)
    expected = quality.scores(network, [data(t) for _, t in awkward()])
    assert all(abs(got[d, data(t)] - s) < 1e-6 for (d, t), s in zip(awkward(), expected.tolist(), strict=True))
    assert [r["text"] for r in scored.orderBy("doc_id", "text").collect()] == [r["text"] for r in docs.orderBy("doc_id", "text").collect()]
    assert len(quality.score(docs, network, "text").columns) == len(docs.columns) + 1


def scores_of(rows):
    name = next(c for c in rows.columns if c.lower() == "text")
    return {(r["doc_id"], data(r[name]) if isinstance(r[name], str | None) else bytes(r[name])): r["score"] for r in rows.collect()}
