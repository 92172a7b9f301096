"""Best-fit packing by bin completion: documents become pieces, pieces fill sequences of equal length.

Only the histogram of piece lengths (at most ``seq_len`` numbers) reaches the driver. There a branch-and-bound fills one
sequence after another around the largest piece left, with undominated completions only, prunes by the waste that
the best solution so far allows, and starts from a best-fit solution. A filling is used as often as the histogram
allows, and less often later in the search. The size of the plan is bounded by ``seq_len`` or the number of branches.
Pieces are then numbered within their length by Spark and look up their place in that plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, pieces as slices, record, text_bytes
from vecbank.llm.tokens import encoder
from vecbank.session import materialize

SEQ_LEN = 1024
END_OF_TEXT = 2
#: Fillings looked at, and branches taken, in all.
NODES = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(total: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens; only the first may be shorter than a sequence."""
    if total <= seq_len:
        return [(0, total)]
    first = total % seq_len or seq_len
    return [(0, first), *((at, seq_len) for at in range(first, total, seq_len))]


def tokenized(docs: DataFrame, seq_len: int = SEQ_LEN, end: int = END_OF_TEXT, path: str | None = None,
              ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32``, the reading task and the piece's number
    among those of its length there (``part, nth``), and on demand the token ids."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("part", pa.int32()), ("nth", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else []),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, met = encoder(path, ranks_path).encode, TaskContext.get().partitionId(), Counter()
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            doc_ids, texts = columns(batch, "doc_id", "text")
            out: dict[str, list] = {name: [] for name in schema.names}
            for doc_id, ids in zip(doc_ids, encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                ids += last
                for number, (start, length) in enumerate(cut(len(ids) // 4, seq_len)):
                    own = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(schema.names, (doc_id, number, start, length, zlib.crc32(own), part, met[length]), strict=False):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
                    met[length] += 1
            yield record(schema, out)

    return docs.select("doc_id", text_bytes()).mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def best_fit(counts: dict[int, int], seq_len: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: around the largest length left, again and again the largest that fits."""
    left, plan = Counter({k: v for k, v in counts.items() if v}), []
    while left:
        order = sorted(left, reverse=True)
        filling, room = Counter({order[0]: 1}), seq_len - order[0]
        for length in order:
            take = min(left[length] - filling[length], room // length)
            if take > 0:
                filling[length] += take
                room -= take * length
        times = min(left[k] // n for k, n in filling.items())
        plan.append((dict(filling), times))
        left = Counter({k: v - times * filling[k] for k, v in left.items() if v > times * filling[k]})
    return plan


def dominated(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``one`` fit into rooms as large as the pieces of ``other`` (both in falling order)."""
    rooms = list(other)
    for length in one:
        fit = [i for i, room in enumerate(rooms) if room >= length]
        if not fit:
            return False
        at = min(fit, key=lambda i: rooms[i])
        rooms[at] -= length
    return True


def completions(left: Counter, largest: int, seq_len: int, allowed: Callable[[], int], steps: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated ways ``(waste, lengths)`` to fill the room beside ``largest``, least waste first, larger pieces first.

    They are listed one by one on demand. Sets of attainable sums (bits of a number) lead straight to fillings of a given
    waste; the end comes at the first waste above ``allowed()`` or when ``steps[0]`` fillings were looked at.
    """
    room, free = seq_len - largest, Counter(left)
    free[largest] -= 1
    lengths = sorted((k for k, v in free.items() if v and k <= room), reverse=True)
    within = (1 << (room + 1)) - 1
    sums = [1]  # of the lengths from a place on
    for length in reversed(lengths):
        bits, copies, share = sums[-1], min(free[length], room // length), 1
        while copies > 0:
            bits |= bits << min(share, copies) * length & within
            copies, share = copies - share, 2 * share
        sums.append(bits)
    sums.reverse()

    def exact(at: int, target: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
            return
        at = max(at, bisect_left(lengths, -target, key=lambda k: -k))
        while at < len(lengths) and sums[at] >> target & 1:
            length = lengths[at]
            for copies in range(min(free[length], target // length), 0, -1):
                if sums[at + 1] >> (target - copies * length) & 1:
                    for rest in exact(at + 1, target - copies * length):
                        yield (length,) * copies + rest
            at += 1

    kept: list[tuple[int, ...]] = []
    for waste in range(room + 1):
        if waste > allowed() or steps[0] <= 0:
            return
        for taken in exact(0, room - waste):
            steps[0] -= 1
            if not any(dominated(taken, k) for k in kept):
                kept.append(taken)
                yield waste, taken
            if steps[0] <= 0:
                return


def branches(left: Counter, seq_len: int, allowed: Callable[[], int], steps: list[int]) -> Iterator[tuple[int, dict[int, int], int]]:
    """``(waste, filling, times)`` around the largest length left: each filling as often as possible, then less often."""
    here, met = Counter(left), []
    largest = max(here)
    for waste, taken in completions(here, largest, seq_len, allowed, steps):
        filling = Counter((largest, *taken))
        most = min(here[k] // n for k, n in filling.items())
        met.append((waste, filling, most))
        yield waste, filling, most
    for waste, filling, most in met:
        for times in range(most - 1, 0, -1):
            yield waste, filling, times


def fewest(counts: dict[int, int], seq_len: int) -> int:
    """A lower bound of the number of sequences: pieces above half a sequence share none, and for each smallest length
    looked at, what lies between it and half a sequence has to fit beside them or into further ones."""
    pieces = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        pieces[length] += n
    mass = pieces * np.arange(seq_len + 1)
    half = seq_len // 2
    best = -(-int(mass.sum()) // seq_len)
    for least in range(half + 1):
        alone, beside = pieces[seq_len - least + 1 :].sum(), slice(half + 1, seq_len - least + 1)
        room = seq_len * pieces[beside].sum() - mass[beside].sum()
        over = max(int(mass[least : half + 1].sum() - room), 0)
        best = max(best, int(alone + pieces[beside].sum()) - (-over // seq_len))
    return best


def plan_bins(counts: dict[int, int], seq_len: int = SEQ_LEN, nodes: int = NODES) -> list[tuple[dict[int, int], int]]:
    """Fillings ({length: pieces}, times used) that hold every piece, in as few sequences as the search finds.

    ``nodes`` bounds both the fillings looked at and the branches taken; a search that ends before it is exhaustive, so its
    plan has the fewest sequences possible.
    """
    total = sum(k * v for k, v in counts.items())
    best = best_fit(counts, seq_len)
    bins = sum(times for _, times in best)
    least = fewest(counts, seq_len)
    left = Counter({k: v for k, v in counts.items() if v})
    # Depth-first with an explicit stack: each level holds its branches not tried yet; the plan says what undoing needs.
    stack: list[Iterator] = []
    plan: list[tuple[dict[int, int], int]] = []
    used = waste = 0
    steps = [nodes]

    def allowed() -> int:
        return (bins - 1) * seq_len - total - waste

    if left and bins > least:
        stack.append(branches(left, seq_len, allowed, steps))
    while stack and nodes > 0 and bins > least:
        if len(plan) == len(stack):  # back at this level: undo its filling
            filling, times = plan.pop()
            for k, n in filling.items():
                left[k] += n * times
            used -= times
            waste -= times * (seq_len - sum(k * n for k, n in filling.items()))
        spent, filling, times = next(stack[-1], (0, None, 0))
        if filling is None:
            stack.pop()
            continue
        nodes -= 1
        if spent * times > allowed():
            continue
        for k, n in filling.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((dict(filling), times))
        used, waste = used + times, waste + spent * times
        if not left:
            best, bins = list(plan), used
            # The level without branches lets the loop undo this filling.
            stack.append(iter(()))
            continue
        stack.append(branches(left, seq_len, allowed, steps))
    return best


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, times, first sequence, offset). The piece with number first + r lies in sequence
    first sequence + r % times, at offset + length * (r // times)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    met: Counter = Counter()
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            rows.setdefault(length, []).append((met[length], times, sequence, offset))
            met[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, end: int = END_OF_TEXT, path: str | None = None,
         ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (``doc_id``, ``text``): ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    and, with ``with_ids``, the piece's token ``ids``.

    A null or empty text is the end token alone. Documents longer than ``seq_len`` are cut, the others stay whole. A null
    doc_id is carried along, repeated rows are packed each. An empty table gives an empty result. Further columns of
    ``docs`` are not looked at.
    """
    rows = materialize(tokenized(docs, seq_len, end, path, ranks_path, with_ids), "pieces")
    counts = materialize(rows.groupBy("part", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = places(plan_bins(histogram, seq_len))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = rows.join(bases, ["part", "length"]).withColumn("number", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, length = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("number", "length"))
            sequence, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            for size in np.unique(length):
                own, spans = np.flatnonzero(length == size), table[int(size)]
                first, times, start, at = spans[np.searchsorted(spans[:, 0], number[own], side="right") - 1].T
                rank = number[own] - first
                sequence[own], offset[own] = start + rank % times, at + size * (rank // times)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return numbered.select(*names, "number").mapInArrow(place, schema)
