"""Plain versions of the operators' rules, and documents with every awkward case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(seed: int = 0):
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, shared passages, near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß漢", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(90))
    text = " ".join(word() for _ in range(150))
    near = text.split(" ")
    near[75] = "changed"
    long = " ".join(word() for _ in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "a b"), (6, "A B"), (7, text), (8, text), (9, " ".join(near)), (10, text.upper()),
        (11, f"start {passage} end"), (12, f"{word()}\n{passage}"), (13, f"{passage} {passage}"), (14, "x" * 700), (15, "y " * 300),
        (16, long), (17, long[1000:90_000]), (7, text), (None, text), (None, None), (18, "<|endoftext|> special"), (-5, "negative id"),
        (19, "two  spaces \n here"), (20, "▁ marker"), (21, "one"), (2**40, "one"),
    ]
    return rows + [(100 + i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, d string, h int, spans int"


def frame(spark, rows):
    """Rows as documents with further columns whose names the operators use themselves."""
    full = [(d, t, "en", "src", None if t is None else len(t), "own", "own", 1, 2) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def data(text):
    return (text or "").encode()


def repeated_bytes(rows, length):
    """doc index -> (n_bytes, n_removed, n_spans, sha)."""
    texts = [data(t) for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(rows, length):
    """For rows with distinct ids: doc_id -> (n_words, n_removed, sha)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_groups(rows, size, similarity):
    """For rows with distinct ids: doc_id -> (n_shingles, component, kept)."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    home = {d: d for d in sets}

    def root(d):
        while home[d] != d:
            d = home[d]
        return d

    index = defaultdict(list)
    for d, s in sets.items():
        shared = Counter(o for x in s for o in index[x])
        for x in s:
            index[x].append(d)
        for o, n in shared.items():
            if 100 * n >= similarity * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                home[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
