"""Cross-tokenizer alignment: how the tokens of two vocabularies cover the same bytes, and how often their tokens meet.

Both tokenizers begin a new token at every single space before a word, so a text falls into units that are encoded and
aligned on their own; tasks keep a bounded memory of units met before. Within a unit, the ends of both tokenizations cut
its bytes into stretches, each covered by one token of either side: a link. Ends that both share close a group.

Counting links of the whole corpus: tasks count the pairs of their units; the distinct pairs get a minimal perfect hash in
segments; per segment, dense count vectors indexed by the hash are built from bounded shares of the partial counts and
summed as a tree. A second pass aligns the documents again and looks the counts up, verifying the key at each slot. The
table travels in rounds of a bounded number of pairs; what a document gains is a sum over its links, so rounds add up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, pieces as slices, record, text_bytes
from vecbank.llm.perfect_hash import BINS, Counts, bins, displaced, slots_of
from vecbank.session import materialize

BYTE_RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A single space before something that is no white space: both tokenizers begin a token there.
CUT = re.compile(r"(?<! ) (?=\S)")
MARK = "▁"
REMEMBERED = 200_000
#: Keys in a segment of the hash, partial counts in a vector, vectors summed at once, and pairs sent to the tasks in a round.
SEGMENT, VECTOR_ROWS, FAN, ROUND = 1 << 15, 1 << 19, 8, 1 << 22


class Aligner:
    """Units with their alignment. ``stats``: tokens of A and B, groups, links, and whether both spell the unit."""

    def __init__(self, ranks_path: str, model_path: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.a_bytes[rank] = word
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("pieces with a space after other characters cross the cuts between units")
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # Every id with the sign after it: between tokens of a group, after its A tokens, after its B tokens.
        self.signed = [f"{i}{sign}" for i in range(len(self.a_bytes)) for sign in ",|"]
        self.signed += [f"{i}{sign}" for i in range(len(names)) for sign in ",;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.stats, self.groups = np.zeros((0, 5), np.int64), []
        self.pairs, self.owners = [], []  # of every learned lot: keys of links, and their units

    def key_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.b_bytes) + b

    def b_of(self, keys: np.ndarray) -> np.ndarray:
        return keys % len(self.b_bytes)

    def _a_ids(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and how many each has. Units that begin with one space are encoded together."""
        plain = np.array([len(u) > 1 and not u[1].isspace() for u in units], bool)
        joint = np.flatnonzero(plain)
        ids = np.array(self.bpe.encode_ordinary("".join([units[i] for i in joint.tolist()])), np.int64)
        owner = joint[np.searchsorted(np.cumsum(sizes[joint]), np.cumsum(self.a_sizes[ids]))] if len(joint) else joint
        for i in np.flatnonzero(~plain).tolist():
            alone = np.array(self.bpe.encode_ordinary(units[i]), np.int64)
            ids, owner = np.r_[ids, alone], np.r_[owner, np.full(len(alone), i)]
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units))

    def learn(self, new: list[str]) -> None:
        """Align new units, given without their leading space."""
        spelled = self.model.encode(new)
        raw = [b" " + u.encode() for u in new]
        good = np.ones(len(new), bool)
        b = np.fromiter(chain.from_iterable(spelled), np.int64)
        sizes, n_b = np.array(list(map(len, raw)), np.int64), np.array(list(map(len, spelled)), np.int64)
        b_owner = np.repeat(np.arange(len(new)), n_b)
        same_sizes = (np.bincount(b_owner, self.b_sizes[b], len(new)) == sizes).all()
        if not same_sizes or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(raw):
            good = np.array([b"".join(map(self.b_bytes.__getitem__, s)) == r for r, s in zip(raw, spelled, strict=True)], bool)
            b, n_b, sizes = b[good[b_owner]], n_b[good], sizes[good]
        stats = np.zeros((len(new), 5), np.int64)
        stats[:, 4] = good
        groups, fine = [""] * len(new), np.flatnonzero(good)
        keys = owner = np.zeros(0, np.int64)
        if len(fine):
            a, n_a = self._a_ids([" " + new[i] for i in fine.tolist()], sizes)
            a_ends, b_ends, unit_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(sizes)
            ends = np.union1d(a_ends, b_ends)
            keys = self.key_of(a[np.searchsorted(a_ends, ends)], b[np.searchsorted(b_ends, ends)])
            place = np.searchsorted(unit_ends, ends)
            owner = fine[place]
            both = np.intersect1d(a_ends, b_ends, assume_unique=True)
            stats[fine, 0], stats[fine, 1] = n_a, n_b
            stats[fine, 2] = np.bincount(np.searchsorted(unit_ends, both), minlength=len(fine))
            stats[fine, 3] = np.bincount(place, minlength=len(fine))
            # Tokens of both sides in the order of their groups, A before B, each with the sign that follows it.
            a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
            order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
            closing = np.r_[np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0]
            signed = np.r_[2 * a, 2 * (b + len(self.a_bytes))] + closing
            texts = list(map(self.signed.__getitem__, signed[order].tolist()))
            last = np.r_[0, np.cumsum(n_a + n_b)].tolist()
            for i, at, end in zip(fine.tolist(), last, last[1:], strict=False):
                groups[i] = "".join(texts[at:end])
        base = len(self.groups)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        self.stats = np.concatenate([self.stats, stats])
        self.groups += groups
        self.pairs.append(keys)
        self.owners.append(owner + base)

    def printed(self, numbers: np.ndarray) -> str:
        """The groups of these units."""
        return "".join(map(self.groups.__getitem__, numbers.tolist()))[:-1]

    def units(self, raw: bytes) -> list[str] | None:
        """The units of a text with a space in front, each without its leading space; None if there is nothing to align."""
        text = raw.decode("utf-8", "replace")
        if not raw or MARK in text or text.encode("utf-8", "replace") != raw:
            return None
        cut = CUT.split(" " + text)
        return cut[1:] if not cut[0] else [cut[0][1:], *cut[1:]]

    def placed(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """The numbers of each text's units; None for texts without tokens, also where a unit is spelled differently."""
        cut = [self.units(t) for t in texts]
        new = list({u for units in cut if units for u in units} - self.known.keys())
        if new:
            self.learn(new)
        numbers = [None if u is None else np.fromiter(map(self.known.__getitem__, u), np.int64, len(u)) for u in cut]
        return [None if n is None or not self.stats[n, 4].all() else n for n in numbers]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str | None, str | None]) -> Aligner:
    """One aligner per Python worker and pair of vocabularies, empty at the start of a task."""
    key = paths[0] or public_tokenizers.path(BYTE_RANKS), paths[1] or public_tokenizers.path(PIECES)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    _aligners[key].forget()
    return _aligners[key]


PARTIAL = pa.schema([("part", pa.int32()), ("bin", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def partial_counts(docs: DataFrame, paths: tuple[str | None, str | None]) -> DataFrame:
    """``part, bin, pair, n``: links of each pair of ids in the documents that a task read, a row per pair and memory of units."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = aligner(paths), TaskContext.get().partitionId()
        times = np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if not own.pairs:
                return
            keys, where = np.unique(np.concatenate(own.pairs), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, where, times[np.concatenate(own.owners)])
            keys, n = keys[n > 0], n[n > 0]
            for at in range(0, len(keys), 1 << 16):
                some = keys[at : at + (1 << 16)]
                yield record(PARTIAL, {"part": np.full(len(some), part, np.int32), "bin": bins(some), "pair": some, "n": n[at : at + (1 << 16)]})

        for batch in slices(batches, "text"):
            if len(own.known) > REMEMBERED:
                yield from told()
                own.forget()
                times = np.zeros(0, np.int64)
            placed = [p for p in own.placed(columns(batch, "text")[0]) if p is not None]
            times = np.r_[times, np.zeros(len(own.groups) - len(times), np.int64)]
            if placed:
                times += np.bincount(np.concatenate(placed), minlength=len(times))
        yield from told()

    return docs.select(text_bytes()).mapInArrow(run, "part int, bin int, pair long, n long")


def hashed_counts(partial: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """A stored row per segment, ``segment, seeds, pairs, counts`` (by slot), the segment of each bin, and the number of pairs."""
    pairs = materialize(partial.select("bin", "pair").distinct(), "pairs")
    number, rows = pairs.count(), partial.count()
    segments = 1
    while segments * SEGMENT < number and segments < BINS:
        segments *= 2
    of_bin = np.arange(BINS) // (BINS // segments)
    segment = (F.col("bin") / (BINS // segments)).cast("int").alias("segment")

    def build(key: tuple, group: pa.Table) -> pa.Table:
        seeds, at_slot = displaced(group.column("pair").to_numpy())
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "seeds": [seeds], "pairs": [at_slot]})

    built = pairs.select(segment, "pair").groupBy("segment").applyInArrow(build, "segment int, seeds array<int>, pairs array<long>")
    built = materialize(built, "hashes")
    salts = max(1, -(-rows // (segments * VECTOR_ROWS)))
    shares = partial.select(segment, (F.col("part") % salts).alias("salt"), "pair", "n")
    functions = built.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    vector = pa.schema([("segment", pa.int32()), ("salt", pa.int32()), ("counts", pa.list_(pa.int64()))])

    def one_vector(key: tuple, counts: list[np.ndarray]) -> pa.Table:
        names = [[k.as_py()] * len(counts) for k in key]
        return pa.table([*names, counts], schema=vector)

    def counted(key: tuple, share: pa.Table, function: pa.Table) -> pa.Table:
        if not share.num_rows:
            return one_vector(key, [])
        seeds, at_slot = (np.asarray(function.column(n)[0].values) for n in ("seeds", "pairs"))
        own = share.column("pair").to_numpy()
        slot = slots_of(own, seeds, len(at_slot))
        if (at_slot[slot] != own).any():
            raise ValueError("a pair is not in its segment of the hash")
        dense = np.zeros(len(at_slot), np.int64)
        np.add.at(dense, slot, share.column("n").to_numpy())
        return one_vector(key, [dense])

    def summed(key: tuple, group: pa.Table) -> pa.Table:
        return one_vector(key, [np.sum([np.asarray(c.values) for c in group.column("counts")], axis=0)])

    schema = "segment int, salt int, counts array<long>"
    vectors = shares.groupBy("segment", "salt").cogroup(functions.groupBy("segment", "salt")).applyInArrow(counted, schema)
    while salts > 1:
        up = vectors.select("segment", (F.col("salt") / FAN).cast("int").alias("salt"), "counts")
        vectors, salts = up.groupBy("segment", "salt").applyInArrow(summed, schema), -(-salts // FAN)
    return materialize(built.join(vectors.drop("salt"), "segment"), "counts"), of_bin, number


ALIGNED = pa.schema([
    ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
    ("groups_sha256", pa.string()), ("row", pa.int64()),
])
COLUMNS = ALIGNED.names[:-1]


def looked_up(docs: DataFrame, table: Counts, most: np.ndarray, paths: tuple[str | None, str | None]) -> DataFrame:
    """The documents with what the links whose counts are at hand add up to."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((table, most))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (counts, best) = aligner(paths), sent.value
        gains = np.zeros((0, 2), np.int64)
        for batch in slices(batches, "text"):
            if len(own.known) > REMEMBERED:
                own.forget()
                gains = np.zeros((0, 2), np.int64)
            doc_ids, texts, rows = columns(batch, "doc_id", "text", "row")
            placed = own.placed(texts)
            if len(gains) < len(own.groups):
                # What this batch taught is the last lot.
                fresh, keys, unit = np.zeros((len(own.groups) - len(gains), 2), np.int64), own.pairs[-1], own.owners[-1] - len(gains)
                n = counts.of_keys(keys)
                np.add.at(fresh[:, 0], unit, (n > 0) & (n == best[own.b_of(keys)]))
                np.add.at(fresh[:, 1], unit, n)
                gains = np.concatenate([gains, fresh])
            out = {name: [] for name in ALIGNED.names}
            for doc_id, numbers, row in zip(doc_ids, placed, rows, strict=True):
                digest, values = "", [0] * 6
                if numbers is not None:
                    digest = hashlib.sha256(own.printed(numbers).encode()).hexdigest()
                    values = [*own.stats[numbers, :4].sum(axis=0).tolist(), *gains[numbers].sum(axis=0).tolist()]
                for name, value in zip(ALIGNED.names, (doc_id, *values, digest, row), strict=True):
                    out[name].append(value)
            yield record(ALIGNED, out)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, row long"
    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A encodes a space and the text, B the text, to which it adds the space; strings of special tokens are plain text. A null or empty
    text, one that is not valid UTF-8, and one that B spells differently (such as with a literal U+2581) have no tokens: zeros
    and an empty digest, and they count for nothing. Null ids and repeated rows are documents of their own. An empty table gives an
    empty result, further columns are not looked at.
    """
    spark = docs.sparkSession
    paths = ranks_path, model_path
    partial = materialize(partial_counts(docs, paths), "partial")
    hashes, of_bin, number = hashed_counts(partial)
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path(PIECES)).get_piece_size()
    most = np.zeros(size_b, np.int64)
    each = hashes.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select((F.col("x.pairs") % size_b).alias("b"), "x.counts")
    for r in each.groupBy("b").agg(F.max("counts").alias("most")).collect():  # at most one row per piece of the vocabulary
        most[r["b"]] = r["most"]
    rows = docs.select("doc_id", text_bytes(), F.monotonically_increasing_id().alias("row"))
    segments = int(of_bin[-1]) + 1
    at_once = max(1, segments * ROUND // max(number, ROUND))
    rounds = []
    for first in range(0, segments, at_once):
        part = hashes.filter((F.col("segment") >= first) & (F.col("segment") < first + at_once)).toArrow()
        as_arrays = [[np.asarray(v.values) for v in part.column(name)] for name in ("seeds", "pairs", "counts")]
        table = Counts.of(of_bin, list(zip(part.column("segment").to_pylist(), *as_arrays, strict=True)))
        rounds.append(looked_up(rows, table, most, paths))
    if len(rounds) == 1:
        return rounds[0].select(*COLUMNS)
    every = rounds[0]
    for later in rounds[1:]:
        every = every.unionByName(later)
    summed = [F.sum(n).alias(n) if n in ("n_best", "count_sum") else F.first(n).alias(n) for n in COLUMNS]
    return every.groupBy("row").agg(*summed).select(*COLUMNS)
