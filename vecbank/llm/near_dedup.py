"""Near-duplicate removal by b-bit MinHash.

Documents with equal shingle sets form a class; everything below is about classes. Each class keeps ``BITS`` low bits of
every minimum, packed into a signature, and one key per band of ``ROWS`` minima. Classes with a common band key are
candidates. Agreeing bits, corrected for chance, estimate the similarity; what may reach the threshold (six standard
deviations are allowed for) is confirmed on the full shingle sets.

Links are only needed as far as they join components, so pairs within a group of near copies are never listed: first
every class is held against the best of the smallest classes of its bands. Then the components that still share a band
are compared, block against block; those with a pair that may reach the threshold form a family. At last the classes of a
family meet with their full sets, in blocks again, and tasks pass on only the links that join components. A pair is left
out only if it is in one component already, shares no band, or is estimated far below the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbank.llm.anchors import keyed, mix, stored, word_symbols
from vecbank.llm.batches import columns, pieces, record
from vecbank.operators.blocks import blocked_join
from vecbank.session import materialize

ROWS = 5
BITS = 2
#: The chance that a pair just at the threshold has no band in common.
MISS = 1e-8
DEVIATIONS = 6.0
#: Minima in a signature; the first of them make the bands.
HASHES = 512
#: Rows of a block that carry full sets.
BLOCK_ROWS = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16


def bands_for(similarity: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**rows))


def least_estimate(similarity: float, hashes: int) -> float:
    """Estimates from here on may belong to pairs of that similarity."""
    chance = 0.5**BITS
    agree = similarity + (1 - similarity) * chance
    return similarity - DEVIATIONS * math.sqrt(agree * (1 - agree) / hashes) / (1 - chance)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case; a shorter text is one shingle."""
    words = word_symbols([text.translate(LOWER)])[0]
    if not len(words):
        return words
    if len(words) < size:
        value = np.array([len(words)], np.uint64)
        for word in words:
            value = mix(value ^ word) + np.uint64(1)
        return mix(value)
    count = len(words) - size + 1
    value = mix(words[:count])
    for i in range(1, size):
        value = mix(value + words[i : i + count])
    return np.unique(value)


class Hashing:
    """``HASHES`` hash functions on 32 bits: multiply and add, the high half of the shingle's hash."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, max(HASHES, -(-bands * rows // 8) * 8)
        self.factor = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima per non-empty set, a bounded number of shingles at a time."""
        n = len(self.factor)
        out = np.full((len(sets), n), np.iinfo(np.uint32).max, np.uint32)
        parts = [(i, s[at : at + BLOCK]) for i, s in enumerate(sets) for at in range(0, len(s), BLOCK)]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= BLOCK):
                size += len(parts[end][1])
                end += 1
            group = parts[at:end]
            x = (np.concatenate([p for _, p in group]) >> np.uint64(32)).astype(np.uint32)
            first = np.r_[0, np.cumsum([len(p) for _, p in group])[:-1]]
            owner = np.array([i for i, _ in group])
            found = np.empty((n, len(group)), np.uint32)
            for j in range(n):
                found[j] = np.minimum.reduceat(x * self.factor[j] + self.shift[j], first)
            np.minimum.at(out, owner, found.T)
            at = end
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key per band."""
        grid = minima[:, : self.bands * self.rows].reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(mix(np.arange(1, self.bands + 1, dtype=np.uint64)), grid.shape[:2])
        for r in range(self.rows):
            key = mix(key ^ grid[:, :, r]) + np.uint64(r + 1)
        return key.view(np.int64)

    def signatures(self, minima: np.ndarray) -> np.ndarray:
        """``BITS`` low bits of every (once more mixed) minimum, packed: the lowest bits of all, then the next."""
        mixed = mix(minima.astype(np.uint64))
        return np.concatenate([np.packbits((mixed >> np.uint64(b)).astype(np.uint8) & 1, axis=1) for b in range(BITS)], axis=1)


POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def estimates(left: np.ndarray, right: np.ndarray, hashes: int) -> np.ndarray:
    """Collision-corrected similarity of signatures, row by row (broadcast)."""
    half = left.shape[-1] // BITS
    differ = left[..., :half] ^ right[..., :half]
    for b in range(1, BITS):
        differ = differ | (left[..., b * half : (b + 1) * half] ^ right[..., b * half : (b + 1) * half])
    agree = 1 - POPULATION[differ].sum(axis=-1, dtype=np.int64) / hashes
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def signed(docs: DataFrame, size: int, hashing: Hashing) -> DataFrame:
    """``doc_id, d, n, k1, k2, keys, sig`` of every document (``doc_id, d, t, text``); k1, k2 identify the shingle set."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
        ("keys", pa.list_(pa.int64())), ("sig", pa.binary()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            doc_id, d, texts = columns(batch, "doc_id", "d", "text")
            sets = [shingles(t, size) for t in texts]
            marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            minima = hashing.minima(sets)
            keys, sig = hashing.keys(minima), hashing.signatures(minima)
            some = [len(s) > 0 for s in sets]
            yield record(schema, {
                "doc_id": doc_id, "d": d, "n": [len(s) for s in sets], "k1": marks[:, 0], "k2": marks[:, 1],
                "keys": [k if s else None for k, s in zip(keys, some, strict=True)],
                "sig": [x.tobytes() if s else None for x, s in zip(sig, some, strict=True)],
            })

    return docs.select("doc_id", "d", "text").mapInArrow(
        run, "doc_id long, d long, n long, k1 long, k2 long, keys array<long>, sig binary"
    )


def estimated(pairs: DataFrame, classes: DataFrame, hashes: int, least: float) -> DataFrame:
    """The pairs ``a, b`` whose estimate reaches ``least``, with it as ``est``."""
    sides = [classes.select(F.col("cls").alias(s), F.col("sig").alias(f"sig_{s}")) for s in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(x), np.uint8).reshape(batch.num_rows, -1) for x in columns(batch, "sig_a", "sig_b"))
                est = estimates(one, two, hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], ["a", "b", "est"]).filter(pa.array(est >= least))

    return both.mapInArrow(run, "a long, b long, est double")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """``pairs`` (``a, b``) with ``linked``: whether 100 * intersection >= similarity * union on the full shingle sets. Stored."""
    needed = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct()
    sets = sets_of(docs, needed, size)
    sides = [sets.select(F.col("d").alias(s), F.col("shingles").alias(f"set_{s}")) for s in ("a", "b")]
    both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "set_a"):
            linked = []
            for x, y in zip(*columns(batch, "set_a", "set_b"), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = overlap(one, two)
                linked.append(100 * shared >= similarity * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return stored(both.mapInArrow(run, "a long, b long, linked boolean"), "confirmed")


def components(links: DataFrame) -> DataFrame:
    """``cls, comp``: the smallest class reachable over ``links`` (``a, b``), for every class in a link. Stored.

    Rounds of contraction: every vertex points to the smallest of itself and its neighbours, pointers are followed to
    their roots by doubling, links are carried over to the roots. Each round at least halves the vertices that are left.
    """
    edges = materialize(links.select("a", "b").filter("a <> b"), "edges")
    labels: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select("a", "to"), "points")
        while True:
            ahead = points.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = materialize(points.join(ahead, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "points")
            points = jumped.select("a", "to")
            if not jumped.filter("moved").limit(1).count():
                break
        if labels is None:
            labels = points.select(F.col("a").alias("cls"), F.col("to").alias("comp"))
        else:
            step = points.select(F.col("a").alias("comp"), F.col("to").alias("next"))
            labels = materialize(labels.join(step, "comp", "left").select("cls", F.coalesce("next", "comp").alias("comp")), "labels")
        root = {s: points.select(F.col("a").alias(s), F.col("to").alias(f"to_{s}")) for s in ("a", "b")}
        moved = edges.join(root["a"], "a").join(root["b"], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = materialize(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
    return labels


class Union:
    """Disjoint sets of numbers; ``join`` tells whether two were apart."""

    def __init__(self):
        self.home: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.home.get(x, x)) != x:
            self.home[x] = x = self.home.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.home[max(x, y)] = min(x, y)
        return x != y


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _joins(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _mixed(rows: DataFrame, group: str) -> DataFrame:
    """``group, main``: groups with several components, and the largest of them. Stored."""
    counts = rows.groupBy(group, "comp").agg(F.count("*").alias("n"))
    found = counts.groupBy(group).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    return materialize(found.filter("comps > 1").select(group, "main"), "mixed")


def possible_joins(rows: DataFrame, hashes: int, least: float) -> DataFrame:
    """Pairs ``a, b`` of components that share a band and hold classes whose estimate reaches ``least``; of the pairs within a
    block only as many as connect the same components. ``rows``: ``key, cls, comp, sig``."""
    open_ = stored(rows.join(_mixed(rows, "key"), "key"), "open")
    left = open_.filter("comp <> main").select("key", F.col("cls").alias("lid"), F.col("comp").alias("lcomp"), F.col("sig").alias("lsig"))
    right = open_.select("key", F.col("cls").alias("rid"), F.col("comp").alias("rcomp"), F.col("sig").alias("rsig"))

    def kernel(one: pa.Table, two: pa.Table) -> pa.RecordBatch | None:
        lcomp, rcomp = one.column("lcomp").to_numpy(), two.column("rcomp").to_numpy()
        lsig, rsig = _signatures(one.column("lsig")), _signatures(two.column("rsig"))
        union, found = Union(), []
        for i in range(len(lcomp)):
            others = np.flatnonzero(rcomp != lcomp[i])
            near = others[estimates(lsig[i], rsig[others], hashes) >= least]
            for comp in np.unique(rcomp[near]).tolist():
                if union.join(int(lcomp[i]), comp):
                    found.append((int(lcomp[i]), comp))
        return _joins(found) if found else None

    return blocked_join(left, right, "key", "lid", "rid", kernel, "a long, b long", 1024, 1024).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``d, shingles`` (sorted 64-bit hashes) of the documents ``wanted`` (``d``). Stored."""
    schema = pa.schema([("d", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            d, texts = columns(batch, "d", "text")
            yield record(schema, {"d": d, "shingles": [shingles(t, size).tobytes() for t in texts]})

    return stored(docs.select("d", "text").join(wanted, "d").mapInArrow(run, "d long, shingles binary"), "sets")


def overlap(one: np.ndarray, two: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    return int((two[at] == one).sum())


def confirmed_joins(rows: DataFrame, hashes: int, least: float, similarity: int) -> DataFrame:
    """Links ``a, b`` between components of a family, confirmed on full sets; of a block only as many as connect the same
    components. ``rows``: ``family, cls, comp, sig, shingles``."""
    open_ = stored(rows.join(_mixed(rows, "family"), "family"), "families")
    left = open_.filter("comp <> main").select(
        "family", F.col("cls").alias("lid"), F.col("comp").alias("lcomp"), F.col("sig").alias("lsig"), F.col("shingles").alias("lset")
    )
    right = open_.select("family", F.col("cls").alias("rid"), F.col("comp").alias("rcomp"), F.col("sig").alias("rsig"), F.col("shingles").alias("rset"))

    def kernel(one: pa.Table, two: pa.Table) -> pa.RecordBatch | None:
        lcomp, rcomp = one.column("lcomp").to_numpy(), two.column("rcomp").to_numpy()
        lsig, rsig = _signatures(one.column("lsig")), _signatures(two.column("rsig"))
        lset, rset = ([np.frombuffer(x, np.uint64) for x in t.column(c).to_pylist()] for t, c in ((one, "lset"), (two, "rset")))
        sizes = np.array([len(x) for x in rset])
        union, found = Union(), []
        for i in range(len(lcomp)):
            n = len(lset[i])
            fit = (rcomp != lcomp[i]) & (100 * np.minimum(sizes, n) >= similarity * np.maximum(sizes, n))
            others = np.flatnonzero(fit)
            est = estimates(lsig[i], rsig[others], hashes)
            for j in others[np.argsort(-est, kind="stable")[: int((est >= least).sum())]].tolist():
                a, b = int(lcomp[i]), int(rcomp[j])
                if union.root(a) == union.root(b):
                    continue
                shared = overlap(lset[i], rset[j])
                if 100 * shared >= similarity * (n + len(rset[j]) - shared):
                    union.join(a, b)
                    found.append((a, b))
        return _joins(found) if found else None

    return blocked_join(left, right, "family", "lid", "rid", kernel, "a long, b long", BLOCK_ROWS, BLOCK_ROWS)


#: Rows without doc_id are numbered by their text, below this number.
NUMBERED = -(1 << 62)


def number_of(doc_id: Column, text: Column) -> Column:
    """The doc_id, or for a missing one a number from the bytes of the text, below all ids from ``NUMBERED`` on."""
    return F.coalesce(doc_id.cast("long"), F.lit(NUMBERED) - 1 - F.shiftrightunsigned(F.xxhash64(text), 2))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: int = 80) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when the Jaccard similarity of their distinct ``size``-word shingles is at least ``similarity`` percent.
    A shorter text is one shingle; a null text or one without words has none and is linked with nothing. The document
    with the smallest doc_id of a component is kept. Rows with equal doc_id are one document: they share all links, and
    all are kept if it is. Rows without doc_id are one document per text and come before all others; a component that
    holds one has no component_id. Ids below -2^62 are taken by those. An empty table gives an empty result. Further
    columns are not looked at.
    """
    return grouped_documents(docs, size, similarity).drop("d")


def without_near_duplicates(docs: DataFrame, size: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    kept = grouped_documents(docs, size, similarity).filter("kept").select("d").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column can clash with ours
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(n)]) for n in ("doc_id", "text"))
    rows = rows.withColumn("d", number_of(doc_id, F.coalesce(text.cast("binary"), F.lit(b""))))
    return rows.join(kept, "d", "left_semi").select(*names).toDF(*docs.columns)


def grouped_documents(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """What ``near_duplicates`` tells, with the number ``d`` of each row."""
    texts = keyed(docs).withColumn("d", number_of(F.col("doc_id"), F.col("text")))
    share = similarity / 100
    hashing = Hashing(bands_for(share))
    hashes, least = len(hashing.factor), least_estimate(share, len(hashing.factor))
    rows = stored(signed(texts, size, hashing), "signed")
    some = rows.filter("n > 0")
    members = materialize(some.groupBy("k1", "k2").agg(F.min("d").alias("cls")), "members")
    classes = some.join(members, ["k1", "k2"]).filter(F.col("d") == F.col("cls")).select("cls", "k1", "k2", "keys", "sig")
    classes = stored(classes.dropDuplicates(["cls", "k1", "k2"]), "classes")
    in_bands = classes.select("cls", F.explode("keys").alias("key"))
    hubs = materialize(in_bands.groupBy("key").agg(F.min("cls").alias("b"), F.count("*").alias("n")).filter("n > 1").select("key", "b"), "hubs")
    bands = stored(in_bands.join(hubs, "key"), "bands")  # key, cls, b: the smallest class of the band
    stars = bands.filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct()
    best = estimated(stars, classes, hashes, least).groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    pairs = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # Rows with equal doc_id and different texts are classes of one number: nothing has to link them.
    labels = components(confirmed(pairs, texts, size, similarity).filter("linked"))
    placed = classes.select("cls", "sig").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    placed = materialize(placed, "placed")
    families = components(possible_joins(bands.select("key", "cls").join(placed, "cls"), hashes, least))
    families = families.select(F.col("cls").alias("comp"), F.col("comp").alias("family"))
    related = materialize(placed.join(families, "comp"), "related")
    sets = sets_of(texts, related.select(F.col("cls").alias("d")).distinct(), size)
    rows_of_families = related.join(sets.withColumnRenamed("d", "cls"), "cls")
    merged = components(confirmed_joins(rows_of_families, hashes, least, similarity)).select(F.col("cls").alias("comp"), F.col("comp").alias("to"))
    labels = placed.select("cls", "comp").join(merged, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")).distinct()
    of_class = members.join(labels, "cls", "left").select("k1", "k2", F.coalesce("comp", "cls").alias("comp"))
    found = rows.join(materialize(of_class, "found"), ["k1", "k2"], "left").withColumn("comp", F.coalesce("comp", "d"))
    # Rows of one doc_id share what any of them reached.
    reached = found.groupBy("d").agg(F.min("comp").alias("comp"))
    result = found.drop("comp").join(reached, "d")
    component = F.when(F.col("comp") >= NUMBERED, F.col("comp"))
    return result.select("d", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("d") == F.col("comp")).alias("kept"))
