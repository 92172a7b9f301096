"""Substring dedup of words: a word goes if a window of ``length`` words around it also starts earlier.

Reference shards are the contents of one anchor (``anchors.py``): equal windows always lie in the same shard. A task
builds the suffix automaton of its shard from the earliest content on and streams every content through it: the
matching statistics, the longest suffix of what was read that occurred before, come with the automaton as it grows, and
a window is marked where they reach ``length``. The automata stay in their tasks: the reference is the corpus itself, so
none of them has a size that would allow to broadcast it. A shard with too many contents is split by longer
shared parts first.
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

LENGTH = 20
GRAM = 6
#: Windows of a block in the rounds that split crowded shards.
BLOCKS = (8, 3, 1)


class SuffixAutomaton:
    """The suffix automaton of all sequences read so far; ``read`` returns the matching statistics of a new one."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, state: int, size: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.size.append(size)
        return len(self.size) - 1

    def _redirect(self, state: int, symbol: object, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]

    def extend(self, last: int, symbol: object) -> tuple[int, int]:
        """The state after ``symbol`` and the length of the longest suffix that had occurred before."""
        known = self.next[last].get(symbol)
        if known is not None:
            if self.size[known] != self.size[last] + 1:
                clone = self._clone(known, self.size[last] + 1)
                self.link[known] = clone
                self._redirect(last, symbol, known, clone)
                known = clone
            return known, self.size[known]
        state = len(self.size)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            to = self.next[at][symbol]
            if self.size[to] != self.size[at] + 1:
                clone = self._clone(to, self.size[at] + 1)
                self.link[to] = clone
                self._redirect(at, symbol, to, clone)
                to = clone
            self.link[state] = to
        return state, self.size[self.link[state]]

    def read(self, sequence: Iterable) -> list[int]:
        """For each place, the longest suffix up to there that ends earlier, in this or a former sequence."""
        state, out = 0, []
        for symbol in sequence:
            state, known = self.extend(state, symbol)
            out.append(known)
        return out


def solve(rows: list[dict], length: int = LENGTH) -> Iterator[tuple[dict, int, int]]:
    """Windows of the rows' contents that occurred in an earlier row (by document, check sum and place)."""
    if len(rows) < 2:
        return
    automaton, last = SuffixAutomaton(), None
    for row in sorted(rows, key=lambda r: (r["d"], r["t"], r["start"])):
        place = row["d"], row["t"], row["start"]
        if place == last:  # a repeated row of the same document
            continue
        last = place
        known = np.array(automaton.read(row["body"].split()))
        for first, n in anchors.runs(known[length - 1 :] >= length):
            yield row, first, n


def cut_words(text: bytes, length: int):
    """The bytes from the first word of n windows to their last."""
    starts, ends = anchors.word_bounds(np.frombuffer(text, np.uint8))
    return lambda start, n: text[starts[start] : ends[start + n + length - 2]]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``d, t, start, n``: n windows of ``length`` words from ``start`` also start earlier. ``docs``: ``d, t, text``."""
    repeated = anchors.repeated_stretches(docs, anchors.word_symbols, length, gram)
    kinds = anchors.counted(repeated)
    cut = lambda text: cut_words(text, length)
    contents = anchors.fetched(docs, kinds.filter(F.col("kinds") > 1), cut, "bodies")
    found = anchors.repeats(contents, anchors.word_symbols, cut, length, BLOCKS, lambda rows: solve(rows, length), later_whole)
    return later_whole(repeated, kinds).select("d", "t", "start", "n").unionByName(found)


def later_whole(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows whose content occurs earlier: all but the first of its kind."""
    often = anchors.stored(kinds.filter(F.col("occ") > 1).select("h", "c", "rep"), "often")
    return rows.join(often, ["h", "c"]).filter(F.struct("d", "t", "start") > F.col("rep"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_words, n_removed, kept_sha256`` and, on demand, the kept words
    joined by spaces as ``kept_text``.

    Words are runs of characters other than space and \\t to \\r, unchanged; null is no words. Documents are ordered by
    doc_id (a missing one first), windows of one document by place; the first occurrence of a window stays. Rows that
    repeat a doc_id with the same text are one document; different texts under one doc_id are ordered by check sum.
    Documents shorter than ``length`` words stay. An empty table gives an empty result. Further columns are not looked at.
    """
    rows = anchors.keyed(docs)
    spans = anchors.by_document(repeated_spans(rows, length, gram))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
        *([("kept_text", pa.string())] if with_text else []),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text, own in zip(*columns(batch, "doc_id", "text", "spans"), strict=True):
                starts, ends = anchors.word_bounds(np.frombuffer(text, np.uint8))
                keep = ~anchors.covered(len(starts), own, length)
                kept = b" ".join([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                values = (doc_id, len(starts), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))
                for name, value in zip(schema.names, values, strict=False):
                    out[name].append(value)
            yield record(schema, out)

    joined = rows.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
