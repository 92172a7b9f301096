"""Exact, near, suffix and substring dedup against their rules."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import awkward, data, frame, near_groups, repeated_bytes, repeated_words

from vecbank.llm import anchors, exact_dedup, near_dedup, substring_dedup, suffix_dedup


def one_each(rows):
    """Without missing and repeated ids."""
    return list({d: (d, t) for d, t in rows if d is not None}.values())


def test_exact_groups(spark):
    rows = awkward()
    got = sorted(map(tuple, exact_dedup.exact_groups(frame(spark, rows)).collect()), key=repr)
    size = Counter(data(t) for _, t in rows)
    keep = {c: max((d for d, t in rows if data(t) == c and d is not None), default=None) for c in size}
    expected = [(d, keep[data(t)], size[data(t)], d == keep[data(t)], hashlib.sha256(data(t)).hexdigest()) for d, t in rows]
    assert got == sorted(expected, key=repr)


def test_exact_dedup_keeps_columns(spark):
    docs = frame(spark, awkward())
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {3, 5, 6, 8, 10, 2**40}
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_grace_spills_and_compares_contents(tmp_path):
    rng = random.Random(1)
    contents = [bytes([rng.randrange(256)]) * rng.randint(1, 60) for _ in range(3000)]
    records = [(exact_dedup.digest_of(c), c, i, 1) for i, c in enumerate(contents)]
    got = {e[1]: (e[2], e[3]) for e in exact_dedup.merged(records, str(tmp_path), limit=4000)}
    assert got == {c: (max(i for i, o in enumerate(contents) if o == c), n) for c, n in Counter(contents).items()}
    assert not any(p.is_file() for p in tmp_path.rglob("*"))
    same_digest = [(b"d" * 32, b"one", 1, 1), (b"d" * 32, b"two", 2, 1), (b"d" * 32, b"one", 3, 1)]
    assert sorted(e[1:] for e in exact_dedup.merged(same_digest, str(tmp_path), limit=100)) == [[b"one", 3, 2], [b"two", 2, 1]]


def test_deep_shallow_order():
    rng = random.Random(2)
    for _ in range(60):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 30))]
        order = suffix_dedup.deep_shallow(strings, shallow=rng.choice([0, 8, 16]))
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


def test_blind_trie_walks_in_order():
    strings = [b"abc", b"", b"ab", b"abc", b"b\0", b"b"]
    trie = suffix_dedup.BlindTrie(strings)
    for i in range(len(strings)):
        trie.insert(i)
    assert [strings[i] for i in trie.order()] == sorted(strings)


@pytest.mark.parametrize("group", [1000, 1])
def test_suffix_dedup(spark, monkeypatch, group):
    """Also with every anchor treated as crowded."""
    monkeypatch.setattr(anchors, "GROUP", group)
    rows = awkward()
    got = sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, repeated_bytes(rows, 200), strict=True)), key=repr)


def test_suffix_dedup_of_texts(spark):
    rows = one_each(awkward())
    docs = frame(spark, rows)
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r for r in cut.collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[7]["text"] == "" and got[4]["text"] == "a b" and got[1]["text"] == "" and got[11]["text"].startswith("start")
    whole = suffix_dedup.whole_characters(np.frombuffer("aéb".encode(), np.uint8), np.array([0, 1, 0, 0], bool))
    assert whole.tolist() == [False, True, True, False]


def test_suffix_automaton_statistics():
    rng = random.Random(3)
    for _ in range(100):
        automaton, seen = substring_dedup.SuffixAutomaton(), set()
        for _ in range(rng.randint(1, 5)):
            text = "".join(rng.choices("ab", k=rng.randint(0, 20)))
            for end, known in enumerate(automaton.read(text), 1):
                assert known == max([end - b for b in range(end) if text[b:end] in seen] + [0])
                seen |= {text[b:end] for b in range(end)}


@pytest.mark.parametrize("group", [1000, 1])
def test_substring_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(anchors, "GROUP", group)
    rows = one_each(awkward())
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == repeated_words(rows, 20)


def test_substring_dedup_of_missing_and_repeated_ids(spark):
    rows = awkward()
    got = substring_dedup.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert len(got) == len(rows)
    assert {r["n_removed"] for r in got if r["doc_id"] is None} == {0}  # first of all
    assert {r["n_removed"] for r in got if r["doc_id"] == 7} == {150}  # the missing id has this text
    assert all(len((r["kept_text"] or "").split()) == r["n_words"] - r["n_removed"] for r in got)


def test_repeated_rows_are_one_document():
    row = {"d": 1, "t": 2, "start": 0, "body": b" ".join(b"w%d" % i for i in range(25))}
    other = {"d": 9, "t": 2, "start": 4, "body": row["body"] + b" end"}
    assert list(substring_dedup.solve([dict(row), dict(row)])) == []
    assert [(r["d"], a, n) for r, a, n in substring_dedup.solve([other, dict(row), dict(row)])] == [(9, 0, 6)]


@pytest.mark.parametrize(("size", "similarity"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, similarity):
    rng = random.Random(size)
    rows = one_each(awkward())
    base = [rng.choice("abcdefghij") + str(i) for i in range(120)]
    for i in range(40):  # a family around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(copy)))
    got = {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(frame(spark, rows), size, similarity).collect()}
    assert got == near_groups(rows, size, similarity)


def test_near_duplicates_of_missing_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "f g h i j"), (5, "f g h i j"), (6, None), (7, ""), (6, None)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert {d for d, _, _ in got} == {None, 3, 5, 6, 7} and (6, 6, True) in got and (7, 7, True) in got and (None, None, True) in got
    assert (3, None, False) in got


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["cls"]: r["comp"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_estimates_are_close():
    hashing = near_dedup.Hashing(64)
    a, b = near_dedup.shingles(" ".join(f"w{i}" for i in range(500)).encode(), 3), near_dedup.shingles(" ".join(f"w{i}" for i in range(100, 600)).encode(), 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    one, two = hashing.signatures(hashing.minima([a, b]))
    assert abs(float(near_dedup.estimates(one, two, near_dedup.HASHES)) - true) < 0.12
    assert (hashing.minima([a[:70], a[70:]]).min(axis=0) == hashing.minima([a])[0]).all()


def test_estimates_may_be_six_deviations_low():
    agree = 0.85 + 0.15 / 4
    deviation = (agree * (1 - agree) / near_dedup.HASHES) ** 0.5 / 0.75
    assert near_dedup.least_estimate(0.85, near_dedup.HASHES) <= 0.85 - 5.99 * deviation


def test_empty_tables(spark):
    docs = frame(spark, awkward()).limit(0)
    for result in (
        exact_dedup.exact_groups(docs), suffix_dedup.remove_repeats(docs), suffix_dedup.without_repeats(docs),
        substring_dedup.remove_repeats(docs), near_dedup.near_duplicates(docs),
    ):
        assert result.collect() == []


def test_stretches_cover_every_window_of_sliced_sequences(monkeypatch):
    monkeypatch.setattr(anchors, "SLICE", 50)
    rng = np.random.default_rng(4)
    values = [anchors.mix(rng.integers(0, 3, n).astype(np.uint64)) for n in (0, 5, 19, 20, 21, 333)]
    seen = Counter()
    for rows, places, held in anchors.buffers(enumerate(values), 20):
        found = anchors.stretch(held, 20, 3)
        for s, start, n in zip(found.sequence, found.start, found.windows, strict=True):
            seen.update((rows[s], places[s] + start + i) for i in range(n))
    assert set(seen) == {(i, p) for i, v in enumerate(values) for p in range(max(len(v) - 19, 0))} and set(seen.values()) == {1}


def test_words_are_told_apart_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(anchors, "REMEMBERED_WORDS", 3)
    long = b"0123456789abcdefghij" * 1000
    first, second = anchors.word_symbols([b"x " + long + b" y", b"a b c d e " + long + b"\n" + long[:-1] + b"\x0b\x0c \x1c\xc2\xa0"])
    assert first[1] == second[5] != second[6] and len(second) == 8


def thue_morse(length, first="a", second="b"):
    """Two texts that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join((first, second)[b] for b in bits), "".join((second, first)[b] for b in bits)


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse(2048)
    texts = [" ".join(f"w{i}" if i != 11 else word for i in range(23)) for word in (one, two)]
    docs = frame(spark, [(1, texts[0]), (2, texts[1])])
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("group", [1000, 1])
def test_long_strings_that_polynomials_confuse(spark, monkeypatch, group):
    monkeypatch.setattr(anchors, "GROUP", group)
    rng = random.Random(7)
    one, two = thue_morse(4096, *(chr(c) for c in (97, 98)))
    around = "".join(rng.choices("cdefghij", k=5000))
    rows = [(1, around + one + around[::-1]), (2, around + two + around[::-1]), (3, "k" + around + one[:100])]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, rows), length=6000).collect()))
    assert got == sorted((d, *x) for (d, _), x in zip(rows, repeated_bytes(rows, 6000), strict=True))


def test_shared_passages_are_settled_by_runs(spark):
    """A passage in many documents makes a row per document, not one per stretch; documents that share only parts lose those."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, other = (" ".join(word() for _ in range(400)) for _ in range(2))
    rows = [(i, f"{word()} {passage} {word()}") for i in range(30)] + [(40, f"{word()} {passage[500:1500]} {word()} {other}"), (41, other[:900])]
    docs = frame(spark, rows)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    assert got == sorted((d, *x) for (d, _), x in zip(rows, repeated_bytes(rows, 200), strict=True))
    keyed = anchors.keyed(docs)
    repeated = anchors.repeated_stretches(keyed, anchors.byte_symbols, 200, 32)
    spans = suffix_dedup.repeated_runs(repeated, anchors.counted(repeated)).filter("d < 30").groupBy("d").count().collect()
    assert repeated.filter("d = 0").count() > 20 and all(r["count"] == 1 for r in spans)


def test_near_copies_without_ids_are_told_apart(spark):
    rng = random.Random(9)
    x, y = (" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(60)) for _ in range(2))
    docs = frame(spark, [(None, x), (None, y), (3, x), (9, y), (None, y + " end"), (None, None), (12, "alone here")])
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 3, 85).collect()]
    assert (3, None, False) in got and (9, None, False) in got and (12, 12, True) in got
    assert sum(k for _, _, k in got) == 4  # x, one of y and its near copy, the empty text, the last
    left = near_dedup.without_near_duplicates(docs, 3, 85)
    assert left.columns == docs.columns
    texts = [r["text"] for r in left.collect()]
    assert len(texts) == 4 and x in texts and (y in texts) != (y + " end" in texts)
