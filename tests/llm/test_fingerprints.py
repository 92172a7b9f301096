"""Document fingerprints against a plain version of their rule."""

import hashlib
from collections import Counter

import numpy as np
from brute import awkward, data, frame

from vecbank.llm import fingerprints


def plain_digest(text):
    counts = Counter()
    for i in range(len(text)):
        for salt, (p, r) in enumerate(fingerprints.TRIPLETS):
            if i >= r:
                counts[(salt << 24 | text[i] << 16 | text[i - p] << 8 | text[i - r]) * fingerprints.MULTIPLIER % 2**32 >> 24] += 1
    every = [counts[b] for b in range(256)]
    limits = [sorted(every)[n] for n in (63, 127, 191)]
    return fingerprints.length_code(len(text)), [sum(c > x for x in limits) for c in every]


def plain_likeness(one, other):
    steps = sum(abs(a - b) for a, b in zip(one[1], other[1], strict=True))
    return 1 - min(384, steps + 8 * min(32, abs(one[0] - other[0]))) / 384


def unpacked(fingerprint):
    raw = bytes.fromhex(fingerprint)
    return raw[0], [b >> s & 3 for b in raw[1:] for s in (6, 4, 2, 0)]


def test_fingerprints_against_the_rule(spark):
    rows = list({d: (d, t) for d, t in awkward() if d is not None}.values())
    order = sorted(rows)
    expected = {}
    for (doc_id, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        text, following = text or "", following or ""
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + following[:quarter]
        expected[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), *map(plain_digest, map(data, (text, changed, following))))
    for partitions in ("1", "40"):  # also with more ranges than rows in some
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = fingerprints.fingerprints(frame(spark, rows).repartition(7)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(got) == len(rows)
        for r in got:
            n, sha, own, changed, following = expected[r["doc_id"]]
            assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
            assert (unpacked(r["fingerprint"]), unpacked(r["edited_fingerprint"])) == (own, changed)
            assert abs(r["near_edited"] - plain_likeness(own, changed)) < 1e-12
            assert abs(r["near_next"] - plain_likeness(own, following)) < 1e-12


def test_fingerprints_of_repeated_and_missing_ids(spark):
    rows = [(None, "a b c d"), (None, None), (5, "same text"), (5, "same text"), (5, "another one"), (9, "")]
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "5", "9", "None", "None"]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 5}) == 2
    assert any(r["doc_id"] == 5 and r["near_next"] == 1.0 for r in got)  # equal rows follow each other
    alone = fingerprints.fingerprints(frame(spark, [(1, "abcdefgh")])).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in alone] == [(1.0, hashlib.sha256(b"abcdefab").hexdigest())]
    assert fingerprints.fingerprints(frame(spark, rows).limit(0)).collect() == []


def test_windows_do_not_change_digests(monkeypatch):
    texts = [b"", b"ab", bytes(range(256)) * 5, b"x" * 1000, b"abc", "é漢字 ß".encode() * 30]
    whole = fingerprints.digests(texts)
    monkeypatch.setattr(fingerprints, "WINDOW_BYTES", 7)
    assert (fingerprints.digests(texts) == whole).all()
    assert [fingerprints.length_code(n) for n in (0, 7, 8, 15, 16, 2**31)] == [0, 7, 8, 15, 16, 232]
    assert np.all(fingerprints.likeness(whole, whole) == 1.0)
