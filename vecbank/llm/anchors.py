"""Finding repeated windows of a corpus without moving every position.

A window is ``window`` consecutive symbols (bytes or words) of one document. Each window has an anchor: its gram of
``gram`` symbols with the smallest hash, the first of equal ones. Equal windows have equal anchors in the same place, so
only windows with the same anchor have to be compared. Consecutive windows of a document that share their anchor
form a stretch; about one stretch begins every ``(window - gram) / 2`` symbols.

1. ``repeated_grams``: anchors that occur at least twice (a count with map-side aggregation over 8 bytes per stretch).
2. ``stretches``: the stretches with such anchors, stored.
3. ``contents``: stretches of equal content are counted; what differs under the same anchor is fetched from the texts.
4. The operators compare the contents of one anchor in a task (``solved``). Anchors with more than ``GROUP`` contents are
   split first (``refined``): stretches are cut into blocks of fewer windows, and the symbols that all windows of a block
   share take the place of the anchor. What is unique then drops out, what is equal is settled by counting, and only
   blocks across which contents begin to differ are cut further. So no group is gathered without bound.

Rolling hashes, which are polynomials modulo 2^64, only say where to look. Contents count as equal by BLAKE2b digests of their
symbols, and the symbol of a word is a BLAKE2b digest of its bytes; contents that differ are compared symbol by symbol.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, memory, pieces, record, text_bytes
from vecbank.session import scratch_path

#: Contents of one anchor that are compared in a task.
GROUP = 1000
#: Symbols hashed at once; longer documents are cut into slices that overlap by a window. Hashing holds about a dozen
#: arrays of 8 bytes a symbol.
SLICE = 1 << 18
PLACE_BITS = 24
MULTIPLIER = 0x9E3779B97F4A7C15
REMEMBERED_WORDS = 500_000

#: Symbols of texts, and a function of a text that gives the bytes of n windows from a start on.
Symbols = Callable[[list[bytes]], list[np.ndarray]]
Cut = Callable[[bytes], Callable[[int, int], bytes]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self, multiplier: int):
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, value in (("up", self.multiplier), ("down", self.inverse)):
                steps = np.full(size, value, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers(MULTIPLIER)


class Hashes:
    """Rolling hashes of a sequence of 64-bit values, equal for equal grams wherever they lie."""

    def __init__(self, values: np.ndarray):
        up, self.down = POWERS.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(MULTIPLIER)) * up[: len(values)], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from minima towards both ends of blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Found:
    """Stretches of a buffer of sequences: sequence, first window (place in the sequence), windows, offset of the
    anchor in the first window, hash of the anchor, hash of the content."""

    sequence: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    gram: np.ndarray
    content: np.ndarray


def stretch(values: list[np.ndarray], window: int, gram: int, with_content: bool = True) -> Found:
    """Stretches of the sequences ``values``, whose total length is below 2^PLACE_BITS."""
    sizes = np.array([len(v) for v in values], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    total = int(first[-1])
    empty = np.zeros(0, np.int64)
    if total < window:
        return Found(*[empty] * 6)
    buffer = np.concatenate(values)
    hashes = Hashes(numbers(buffer))
    grams = hashes.grams(gram)
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchors = (sliding_least((grams & ~low) | places, window - gram + 1) & low).astype(np.int64)
    ok = np.zeros(total, bool)
    for a, size in zip(first[:-1].tolist(), sizes.tolist(), strict=True):
        if size >= window:
            ok[a : a + size - window + 1] = True
    at = np.flatnonzero(ok[: len(anchors)])
    if not len(at):
        return Found(*[empty] * 6)
    anchor = anchors[at]
    begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(anchor) != 0)])
    start, windows, anchor = at[begins], np.diff(np.r_[begins, len(at)]), anchor[begins]
    sequence = np.searchsorted(first, start, side="right") - 1
    end = start + windows + window - 1
    content = empty
    if with_content:
        content = digests(buffer, start, end, windows, anchor - start)
    return Found(sequence, start - first[sequence], windows, anchor - start, grams[anchor].view(np.int64), content)


def buffers(values: Iterable[tuple[int, np.ndarray]], window: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Group (row, sequence) into buffers of about SLICE symbols: rows, places of the slices in their sequence, slices."""
    rows, places, held, size = [], [], [], 0
    for row, value in values:
        for at in range(0, max(len(value) - window + 1, 0), SLICE):
            part = value[at : at + SLICE + window - 1]
            rows.append(row)
            places.append(at)
            held.append(part)
            size += len(part)
            if size >= SLICE:
                yield rows, places, held
                rows, places, held, size = [], [], [], 0
    if held:
        yield rows, places, held


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def byte_symbols(texts: list[bytes]) -> list[np.ndarray]:
    memory("bytes")  # they need none
    return [np.frombuffer(t, np.uint8) for t in texts]


def numbers(symbols: np.ndarray) -> np.ndarray:
    """Symbols as 64-bit values; bytes become them only here, a bounded buffer at a time."""
    return BYTE_VALUES[symbols] if symbols.dtype == np.uint8 else symbols


def digests(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, *shape: np.ndarray) -> np.ndarray:
    """64-bit digests of the ranges start..end together with the numbers of their shape."""
    size, data = symbols.itemsize, memoryview(np.ascontiguousarray(symbols)).cast("B")
    told = np.column_stack([s.astype("<i8") for s in shape]).tobytes()
    width = 8 * len(shape)
    found = b"".join(
        hashlib.blake2b(data[a:b], digest_size=8, salt=told[i : i + width][:16]).digest()
        for i, a, b in zip(range(0, len(told), width), (start * size).tolist(), (end * size).tolist(), strict=True)
    )
    return np.frombuffer(found, "<i8")


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than space and \\t to \\r."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_symbols(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit digest of each word of each text; a bounded number of words is remembered in a Python worker."""
    out, known = [], memory("words")
    for text in texts:
        words = text.split()  # at the same bytes as ``word_bounds``
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for word in {w for w in words if w not in known}:
            known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, d, t, text``: the id (missing: the least long) and a hash of the text, which tell documents apart, and the bytes."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), text_bytes())
    return rows.select("doc_id", "d", F.xxhash64("text").alias("t"), "text")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor repeats its own tasks only.

    Afterwards the driver's garbage may go, and with it Spark removes the shuffle files of the finished job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grams_of(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """``h``: the anchor of every stretch."""
    schema = pa.schema([("h", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values = enumerate(symbols(columns(batch, "text")[0]))
            for _, _, held in buffers(values, window):
                yield record(schema, {"h": stretch(held, window, gram, with_content=False).gram})

    return docs.select("text").mapInArrow(run, "h long")


def stretches_of(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """``h, c, d, t, start, n, off``: anchor, content, document, first window, windows and offset of the anchor."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, places, held in buffers(enumerate(symbols(columns(batch, "text")[0])), window):
                found = stretch(held, window, gram)
                row, place = np.array(rows)[found.sequence], np.array(places)[found.sequence]
                yield record(schema, {
                    "h": found.gram, "c": found.content, "d": d[row], "t": t[row], "start": found.start + place,
                    "n": found.windows.astype(np.int32), "off": found.offset.astype(np.int32),
                })

    return docs.select("d", "t", "text").mapInArrow(run, "h long, c long, d long, t long, start long, n int, off int")


def repeated_stretches(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """The stretches of ``docs`` (``d, t, text``) whose anchor occurs at least twice, stored."""
    counts = grams_of(docs, symbols, window, gram).groupBy("h").count()
    repeated = stored(counts.filter(F.col("count") > 1).select("h"), "grams")
    return stored(stretches_of(docs, symbols, window, gram).join(repeated, "h", "left_semi"), "stretches")


def counted(rows: DataFrame, occurrences: str = "count(*)") -> DataFrame:
    """One row per anchor and content, stored: ``h, c, occ`` (occurrences), ``rep`` (the first: d, t, start), ``n, off``, and
    ``kinds``, ``single``: contents of the anchor, and whether one of them occurs once."""
    kinds = stored(
        rows.groupBy("h", "c").agg(
            F.expr(occurrences).alias("occ"), F.min(F.struct("d", "t", "start")).alias("rep"), F.min("n").alias("n"), F.min("off").alias("off")
        ), "kinds",
    )
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), (F.min("occ") == 1).alias("single"))
    return stored(kinds.join(groups, "h"), "contents")


def fetched(docs: DataFrame, wanted: DataFrame, cut: Cut, name: str) -> DataFrame:
    """The contents ``wanted`` (``h, occ, rep, n, off, kinds``) with their bytes as the column ``body``, stored."""
    by_doc = wanted.groupBy(F.col("rep.d").alias("d"), F.col("rep.t").alias("t")).agg(
        F.collect_list(F.struct("h", "occ", F.col("rep.start").alias("start"), "n", "off", "kinds")).alias("wanted")
    )
    schema = "h long, occ long, d long, t long, start long, n int, off int, kinds long, body binary"
    arrow = pa.schema([
        ("h", pa.int64()), ("occ", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("n", pa.int32()),
        ("off", pa.int32()), ("kinds", pa.int64()), ("body", pa.binary()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in arrow}
            for d, t, text, rows in zip(*columns(batch, "d", "t", "text", "wanted"), strict=True):
                body = cut(text)
                for row in rows:
                    for key in ("h", "occ", "start", "n", "off", "kinds"):
                        out[key].append(row[key])
                    out["d"].append(d)
                    out["t"].append(t)
                    out["body"].append(body(row["start"], row["n"]))
            yield record(arrow, out)

    texts = docs.join(by_doc, ["d", "t"]).select("d", "t", "text", "wanted")
    return stored(texts.mapInArrow(run, schema), name)


def grouped(rows: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches sorted by ``h``, one list per value, across batch borders."""
    held: list[dict] = []
    for batch in rows:
        for row in batch.to_pylist():
            if held and held[0]["h"] != row["h"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


SPAN = "d long, t long, start long, n int"
SPAN_ARROW = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, length) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    yield from zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True)


def solved(contents: DataFrame, solve: Callable[[list[dict]], Iterable[tuple[dict, int, int]]]) -> DataFrame:
    """Spans ``d, t, start, n`` (n windows from start) by comparing the contents of one anchor in a task. ``solve`` takes the
    rows of an anchor and gives (row, first window, windows)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in grouped(batches):
            out += [(row["d"], row["t"], row["start"] + first, n) for row, first, n in solve(rows)]
            if len(out) > 20_000:
                yield record(SPAN_ARROW, dict(zip(SPAN_ARROW.names, zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield record(SPAN_ARROW, dict(zip(SPAN_ARROW.names, zip(*out, strict=True), strict=True)))

    few = contents.filter(F.col("kinds") <= GROUP)
    return few.repartition(partitions(contents.sparkSession), "h").sortWithinPartitions("h").mapInArrow(run, SPAN)


def refined(contents: DataFrame, symbols: Symbols, cut: Cut, window: int, block: int) -> DataFrame:
    """Contents of crowded anchors cut into blocks of ``block`` windows, counted from the anchor: rows like ``contents`` with
    ``c``, keyed by block and shared symbols (``h``). Stored."""
    arrow = pa.schema([
        ("h", pa.int64()), ("c", pa.int64()), ("occ", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("start", pa.int64()),
        ("n", pa.int32()), ("off", pa.int32()), ("body", pa.binary()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out: dict[str, list] = {f.name: [] for f in arrow}
                rows = part.to_pylist()
                for row, values in zip(rows, symbols([r["body"] for r in rows]), strict=True):
                    # Window j begins off - j symbols before the anchor; blocks are aligned to that distance.
                    distance = row["off"] - np.arange(row["n"])
                    number = distance // block
                    first = np.flatnonzero(np.r_[True, np.diff(number) != 0])
                    size = np.diff(np.r_[first, row["n"]])
                    seed = np.array([row["h"] & (2**64 - 1)], np.uint64)
                    # What every window of the whole block holds, whether or not this content has all of them.
                    nearest = row["off"] - number[first] * block
                    core = digests(values, nearest, nearest - block + 1 + window, number[first]).view(np.uint64)
                    out["h"] += mix(core ^ mix(seed)).view(np.int64).tolist()
                    out["c"] += digests(values, first, first + size + window - 1, size, distance[first]).tolist()
                    body = cut(row["body"])
                    for at, n in zip(first.tolist(), size.tolist(), strict=True):
                        for key in ("occ", "d", "t"):
                            out[key].append(row[key])
                        out["start"].append(row["start"] + at)
                        out["n"].append(n)
                        out["off"].append(row["off"] - at)
                        out["body"].append(body(at, n))
                yield record(arrow, out)

    rows = contents.select("h", "occ", "d", "t", "start", "n", "off", "body")
    return stored(rows.mapInArrow(run, "h long, c long, occ long, d long, t long, start long, n int, off int, body binary"), "blocks")


def repeats(contents: DataFrame, symbols: Symbols, cut: Cut, window: int, blocks: tuple[int, ...], solve: Callable, equal: Callable) -> DataFrame:
    """Spans of windows that repeat among fetched ``contents``: compared in tasks where an anchor has few of them, after
    refining where it has many. ``blocks``: windows of a block in each round, below ``window``, the last 1.
    ``equal(rows, kinds)`` gives the rows that repeat another of equal content as a whole."""
    spans = solved(contents, solve)
    for block in blocks:
        crowded = contents.filter(F.col("kinds") > GROUP)
        if not crowded.limit(1).count():
            break
        rows = refined(crowded, symbols, cut, window, block)
        kinds = counted(rows, "sum(occ)")
        spans = spans.unionByName(equal(rows, kinds).select("d", "t", "start", "n"))
        first = kinds.filter("kinds > 1").select("h", "c", F.col("occ").alias("times"), "kinds", "rep")
        met = rows.join(first, ["h", "c"]).filter(F.struct("d", "t", "start") == F.col("rep"))
        contents = stored(met.select("h", F.col("times").alias("occ"), "d", "t", "start", "n", "off", "kinds", "body"), "bodies")
        spans = spans.unionByName(solved(contents, solve))
    return spans


def by_document(spans: DataFrame) -> DataFrame:
    """``d, t, spans``: the spans of each document in one array (at most one per stretch of it and window of crowded anchors)."""
    return spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(size: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window of the spans."""
    edge = np.zeros(size + 1, np.int64)
    for span in spans or ():
        edge[span["start"]] += 1
        edge[min(span["start"] + span["n"] + window - 1, size)] -= 1
    return np.cumsum(edge[:size]) > 0
