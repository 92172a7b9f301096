"""Suffix-array dedup of bytes: every byte covered by a string of ``length`` bytes that also starts elsewhere goes.

Where repeats can be is found by anchors (``anchors.py``). The suffixes that begin at the anchors of one kind are sorted
by deep-shallow sorting: a multikey quicksort on characters of eight bytes down to a shallow depth, then blind tries for
the groups that still agree. Longest common prefixes of neighbours say how far two places agree to the right of the
anchor; a blind trie of the bytes before it, read backwards, says how far they agree to the left. A window is
repeated if both together span it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbank.llm import anchors
from vecbank.llm.batches import columns, pieces, record

LENGTH = 200
GRAM = 32
CHARACTER = 8
SHALLOW = 64
#: Windows of a block in the rounds that split crowded anchors.
BLOCKS = (64, 16, 4, 1)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie whose edges keep only their first byte; a search compares with one of the strings it meets.

    Nodes are [depth, {byte: node}, strings that end here]; byte -1 stands for the end of a string.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def insert(self, index: int) -> None:
        text = self.strings[index]
        leaf = [len(text), {}, [index]]
        if self.root is None:
            self.root = leaf
            return
        node, path = self.root, []
        while True:  # blind descent
            path.append(node)
            child = node[1].get(text[node[0]] if node[0] < len(text) else -1)
            if child is None:
                break
            node = child
        other = node
        while not other[2]:
            other = next(iter(other[1].values()))
        known = self.strings[other[2][0]]
        depth = common(text, known)
        if depth == len(text) == len(known):
            other[2].append(index)
            return
        at = next((i for i, n in enumerate(path) if n[0] >= depth), len(path))
        if at < len(path) and path[at][0] == depth and not (path[at][2] and not path[at][1]):
            path[at][1][text[depth] if depth < len(text) else -1] = leaf
            return
        below = path[at] if at < len(path) else other
        first = known[depth] if depth < len(known) else -1
        branch = [depth, {first: below, text[depth] if depth < len(text) else -1: leaf}, []]
        if at == 0:
            self.root = branch
        else:
            above = path[at - 1]
            above[1][known[above[0]] if above[0] < len(known) else -1] = branch

    def walk(self) -> Iterator[tuple[int, list]]:
        """(parent depth, node) of every node, parents first, children in byte order."""
        stack = [(-1, self.root)] if self.root else []
        while stack:
            up, node = stack.pop()
            yield up, node
            stack.extend((node[0], node[1][byte]) for byte in sorted(node[1], reverse=True))

    def order(self) -> list[int]:
        return [i for _, node in self.walk() for i in node[2]]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in byte order: multikey quicksort down to ``shallow`` bytes, blind tries below."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for index in group:
                trie.insert(index)
            out += trie.order()
            continue
        end = depth + CHARACTER
        pivot = strings[group[len(group) // 2]][depth:end]
        less, equal, more = [], [], []
        for index in group:
            character = strings[index][depth:end]
            (equal if character == pivot else less if character < pivot else more).append(index)
        # Strings that end inside this character and agree in it are equal.
        ended = len(pivot) < CHARACTER
        stack.append((more, depth))
        stack += [([i], depth) for i in reversed(equal)] if ended else [(equal, end)]
        stack.append((less, depth))
    return out


def repeated_windows(bodies: list[bytes], offsets: list[int], counts: list[int], length: int) -> list[np.ndarray]:
    """For contents that share an anchor (at ``offsets``), which of their windows (``counts`` of them) occur in another one."""
    flags = [np.zeros(n, bool) for n in counts]
    rights = [b[o:] for b, o in zip(bodies, offsets, strict=True)]
    lefts = [b[:o][::-1] for b, o in zip(bodies, offsets, strict=True)]

    def mark(i: int, above: int, left: int, right: int) -> None:
        """Windows that begin above < x <= left bytes before the anchor and end within ``right`` bytes after it."""
        least = max(above + 1, length - right)
        first, last = offsets[i] - left, offsets[i] - least
        if last >= 0 and first <= last:
            flags[i][max(first, 0) : last + 1] = True

    if len(bodies) == 2:
        left, right = common(*lefts), common(*rights)
        for i in (0, 1):
            mark(i, -1, left, right)
        return flags
    order = deep_shallow(rights)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lcp = np.array([common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)] + [0], np.int64)
    trie = BlindTrie(lefts)
    for i in range(len(lefts)):
        trie.insert(i)
    members: dict[int, np.ndarray] = {}
    nodes = list(trie.walk())
    for _, node in reversed(nodes):
        below = [members.pop(id(child)) for child in node[1].values()]
        own = rank[node[2]] if node[2] else np.zeros(0, np.int64)
        members[id(node)] = np.sort(np.concatenate([own, *below])) if below else np.sort(own)
        node.append(members[id(node)])
    for up, node in nodes:
        ranks = node[3]
        if len(ranks) < 2:
            continue
        between = np.minimum.reduceat(lcp, ranks)[:-1]  # the least from one member up to the next
        right = np.maximum(np.r_[0, between], np.r_[between, 0])
        for r, reach in zip(ranks.tolist(), right.tolist(), strict=True):
            if reach + node[0] >= length:
                mark(order[r], up, node[0], reach)
    return flags


def solve(rows: list[dict], length: int = LENGTH) -> Iterator[tuple[dict, int, int]]:
    if len(rows) < 2:
        return
    found = repeated_windows([r["body"] for r in rows], [r["off"] for r in rows], [r["n"] for r in rows], length)
    for row, flags in zip(rows, found, strict=True):
        if row["occ"] == 1:  # contents that occur more often are repeated as a whole
            for first, n in anchors.runs(flags):
                yield row, first, n


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``d, t, start, n``: n windows of ``length`` bytes from ``start`` occur elsewhere. ``docs``: ``d, t, text``."""
    repeated = anchors.repeated_stretches(docs, anchors.byte_symbols, length, gram)
    kinds = anchors.counted(repeated)
    open_ = kinds.filter((F.col("kinds") > 1) & F.col("single"))
    cut = lambda text: lambda start, n: text[start : start + n + length - 1]
    contents = anchors.fetched(docs, open_, cut, "bodies")
    found = anchors.repeats(contents, anchors.byte_symbols, cut, length, BLOCKS, lambda rows: solve(rows, length), repeated_whole)
    return repeated_runs(repeated, kinds).unionByName(found)


def repeated_whole(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows whose content occurs at least twice."""
    often = anchors.stored(kinds.filter(F.col("occ") > 1).select("h", "c"), "often")
    return rows.join(often, ["h", "c"], "left_semi")


UNIT = "d long, t long, u long, start long, n int, h long, c long"
UNIT_ARROW = pa.schema([
    ("d", pa.int64()), ("t", pa.int64()), ("u", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("c", pa.int64()),
])


def in_runs(rows: DataFrame) -> DataFrame:
    """Stretches (``h, c, d, t, start, n``) of each document that follow each other without a gap, as runs: a row with the digest
    ``u`` for the inside of a run of several, then a row without one for each of its stretches. Stored.

    A passage that many documents share is a run in each. Its first and last stretch reach into what stands around it, so
    the inside alone is told by one digest.
    """
    listed = rows.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("start", "n", "h", "c"))).alias("own"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for d, t, own in zip(*columns(batch.slice(at, 256), "d", "t", "own"), strict=True):
                    first = 0
                    for i in range(len(own)):
                        if i + 1 < len(own) and own[i + 1]["start"] == own[i]["start"] + own[i]["n"]:
                            continue
                        inside = own[first + 1 : i]
                        if len(inside) > 1:
                            told = b"".join(x.to_bytes(8, "little", signed=True) for s in inside for x in (s["h"], s["c"], s["n"]))
                            unit = int.from_bytes(hashlib.blake2b(told, digest_size=8).digest(), "little", signed=True)
                            out.append((d, t, unit, inside[0]["start"], sum(s["n"] for s in inside), None, None))
                        else:
                            unit = None
                        # The inside of a unit waits for it; the others stand alone.
                        out += [(d, t, unit if 0 < j - first and j < i else None, s["start"], s["n"], s["h"], s["c"])
                                for j, s in enumerate(own[first : i + 1], first)]
                        first = i + 1
                if out:
                    yield record(UNIT_ARROW, dict(zip(UNIT_ARROW.names, zip(*out, strict=True), strict=True)))

    return anchors.stored(listed.mapInArrow(run, UNIT), "runs")


def repeated_runs(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """``d, t, start, n`` of what occurs at least twice as a whole: insides of runs, one row each, and stretches beside them."""
    runs = in_runs(rows)
    units = runs.filter(F.isnull("h") & F.isnotnull("u"))
    often = anchors.stored(units.groupBy("u").count().filter("count > 1").select("u"), "units")
    alone = runs.filter(F.isnotnull("h")).join(often, "u", "left_anti")
    whole = units.join(often, "u", "left_semi").select("d", "t", "start", "n")
    return whole.unionByName(repeated_whole(alone, kinds).select("d", "t", "start", "n"))


def whole_characters(text: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """``removed`` widened to all bytes of each UTF-8 character that loses one."""
    if not len(text):
        return removed
    character = np.cumsum((text & 0xC0) != 0x80)
    return np.bincount(character, weights=removed)[character] > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with its columns, the repeated strings cut out of ``text``, and ``n_chars`` (if there) counted anew.

    A character goes if any of its bytes does, so what stays is text again; a null text becomes the empty one. No row
    goes, not even one whose whole text was repeated. Cases as in ``remove_repeats``.
    """
    spans = anchors.by_document(repeated_spans(anchors.keyed(docs), length, gram))
    rows = docs.withColumns({
        "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__text": anchors.text_bytes().alias("__text"),
    }).withColumn("__t", F.xxhash64("__text"))
    marked = rows.join(spans.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("spans").alias("__spans")), ["__d", "__t"], "left")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            texts = []
            for text, own in zip(*columns(batch, "__text", "__spans"), strict=True):
                if own:
                    data = np.frombuffer(text, np.uint8)
                    text = data[~whole_characters(data, anchors.covered(len(data), own, length))].tobytes()
                texts.append(text.decode("utf-8", "replace"))
            own = [batch.column(i) for i in range(len(names))]
            own[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                own[names.index("n_chars")] = pa.array([len(t) for t in texts], pa.int64()).cast(own[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(own, names)

    # The text travels once, as bytes.
    slim = marked.withColumn("text", F.lit(None).cast("string")).select(*names, "__text", "__spans")
    return slim.mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_content: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, on demand, the
    remaining bytes as ``content``.

    Texts are whole UTF-8 byte strings; null is empty; matches never cross documents. All copies of a repeated string go,
    also those that overlap themselves. A null doc_id is carried along. Rows that repeat a doc_id with the same text
    count as two places, so each removes the other. Texts shorter than ``length`` stay. An empty table gives an empty
    result. Further columns are not looked at.
    """
    rows = anchors.keyed(docs)
    spans = anchors.by_document(repeated_spans(rows, length, gram))
    extra = ", content binary" if with_content else ""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), *([("content", pa.binary())] if with_content else []),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text, own in zip(*columns(batch, "doc_id", "text", "spans"), strict=True):
                removed = anchors.covered(len(text), own, length) if own else np.zeros(len(text), bool)
                kept = np.frombuffer(text, np.uint8)[~removed].tobytes() if own else text
                n_spans = int(removed[:1].sum() + (np.diff(removed.astype(np.int8)) == 1).sum())
                values = (doc_id, len(text), int(removed.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept)
                for name, value in zip(schema.names, values, strict=False):
                    out[name].append(value)
            yield record(schema, out)

    joined = rows.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
