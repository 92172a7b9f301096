"""Cross-tokenizer alignment against a plain version that encodes whole texts with both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import awkward, frame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from vecbank.llm import alignment, perfect_hash


def plain_alignments(rows):
    """Per row: None, or (A ids, B ids, groups, links as id pairs)."""
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = {c: b for b, c in byte_letters().items()}
    out = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = one.encode(whole.decode(), add_special_tokens=False).ids, two.encode(text or "")
        spelled_a = [bytes(level[c] for c in one.id_to_token(i)) for i in a]
        names = [two.id_to_piece(i) for i in b]
        spelled_b = [bytes([int(n[3:5], 16)]) if two.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names, strict=True)]
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            out.append(None)
            continue
        spans = [[], []]
        for side, spelled in enumerate((spelled_a, spelled_b)):
            at = 0
            for s in spelled:
                spans[side].append((at, at + len(s)))
                at += len(s)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        begins = [0, *ends[:-1]]
        inside = lambda ids, own, lo, hi: ",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if lo <= s and e <= hi)
        groups = [inside(a, spans[0], lo, hi) + "|" + inside(b, spans[1], lo, hi) for lo, hi in zip(begins, ends, strict=True)]
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        out.append((a, b, groups, links))
    return out


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    assert set(letters.values()) == set(ByteLevel.alphabet())
    return letters


def samples():
    rng = random.Random(3)
    rows = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in awkward()]
    spaces = [" ", "  ", "\n", " \n ", "\t", "   ", " ", "　 ", " \x1c", "\r\n"]
    for i in range(60):
        words = ["".join(rng.choices("abcXYZé漢🙂'.,0123", k=rng.randint(0, 7))) for _ in range(rng.randint(1, 25))]
        rows.append((500 + i, "".join(w + rng.choice(spaces) for w in words)))
    return rows + [(600, " lead"), (601, "  lead"), (602, "trail "), (603, " "), (604, "   "), (605, "don't we'll <s> </s> <unk> <0x41>"), (606, "a\0b")]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_both_libraries(spark, monkeypatch, small):
    if small:  # many segments, vectors, levels of the tree and rounds, and a memory that is emptied all the time
        for name, value in dict(SEGMENT=16, VECTOR_ROWS=2, ROUND=100).items():
            monkeypatch.setattr(alignment, name, value)
    rows = samples()
    plain = plain_alignments(rows)
    count = Counter(link for p in plain if p for link in p[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    expected = []
    for (doc_id, _), p in zip(rows, plain, strict=True):
        if p is None:
            expected.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = p
            best = sum(count[x] == most[x[1]] for x in links)
            expected.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(map(count.__getitem__, links)),
                             hashlib.sha256(";".join(groups).encode()).hexdigest()))
    got = sorted(map(tuple, alignment.align(frame(spark, rows).repartition(9)).collect()), key=repr)
    assert got == sorted(expected, key=repr)
    assert sum(p is None for p in plain) >= 4


def test_forgotten_units_are_counted(spark):
    own = alignment.aligner((None, None))
    first = own.placed([b"one two", b"two three"])
    assert len(own.known) == 3 and [len(n) for n in first] == [2, 2]
    assert own.placed([b"", "▁".encode(), b"\xff", b"two"])[:3] == [None] * 3
    assert alignment.align(frame(spark, awkward()).limit(0)).collect() == []
    nothing = alignment.align(frame(spark, [(1, None), (2, "")])).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("m", [1, 2, 3, 5, 64, 1000, 20_000])
def test_hash_is_minimal_perfect_and_verified(m):
    rng = np.random.default_rng(m)
    keys = rng.choice(1 << 31, m, replace=False).astype(np.int64)
    seeds, at_slot = perfect_hash.displaced(keys)
    slots = perfect_hash.slots_of(keys, seeds, m)
    assert sorted(slots.tolist()) == list(range(m)) and (at_slot[slots] == keys).all()
    table = perfect_hash.Counts.of(np.zeros(perfect_hash.BINS, np.int64), [(0, seeds, at_slot, at_slot % 97)])
    assert (table.of_keys(keys) == keys % 97).all()
    assert (table.of_keys(keys + (1 << 32)) == 0).all()
