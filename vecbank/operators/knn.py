"""Exact top-k search by dot product, for few or many queries.

Similarities are double precision and rounded to 12 decimals before ranking, so copies of one vector
tie exactly and the lower ``row_id`` wins whatever the block layout was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecbank.functions.vectors import as_double, list_matrix
from vecbank.operators.blocks import BLOCK_ROWS
from vecbank.settings import TOP_K

SIM_DECIMALS = 12
BROADCAST_ROWS = 4096
#: Top pivots, and leaves per top pivot on average.
MAX_PIVOTS, LEAVES = 1024, 32
_QUERY_CHUNK, _ROUTE_CHUNK = 512, 256
_MARGIN, _LOOSE = 1e-11, 1e-9
#: Values of a shard of the bank, which a task holds; pairs that a task compares at most, and at least if there are fewer than PARALLEL tasks.
SHARD_VALUES = 1 << 22
MOST_PAIRS, FEW_PAIRS, PARALLEL, MOST_TASKS = 1 << 31, 1 << 26, 16, 1 << 14
_HITS = "query_id long, row_id long, species string, sim double"


def top_k_hits(
    queries: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) positions of the k best rows per query, ties by row id.

    A single-precision product finds the candidates: everything that its rounding error could still
    lift over the k-th best. Only those are multiplied in double precision and ranked. ``floor`` holds
    similarities that are already reached k times; rows below it are not looked at.
    """
    approx = queries.astype(np.float32) @ rows.astype(np.float32, copy=False).T
    longest = np.sqrt(np.nanmax(np.einsum("ij,ij->i", rows, rows, dtype=np.float64), initial=0.0))
    # Bound of the error of a product of dim values, inputs rounded to single precision as well.
    slack = (queries.shape[1] + 8) * 2.0**-24 * np.linalg.norm(queries, axis=1) * longest + _MARGIN
    n_rows = approx.shape[1]
    if floor is not None:
        least = floor - slack
    elif n_rows > k:
        least = np.partition(approx, n_rows - k, axis=1)[:, n_rows - k] - 2 * slack
    else:
        least = np.full(len(queries), -np.inf)
    near = approx >= least.astype(np.float32)[:, None] - np.float32(1e-6)
    q, r = np.divmod(np.flatnonzero(near), max(1, n_rows))  # several times faster than nonzero() in two dimensions
    best = np.round(_dots(queries, rows, q, r), SIM_DECIMALS)
    order = np.lexsort((row_ids[r], -best, q))
    q, r, best = q[order], r[order], best[order]
    keep = _rank(q, len(queries)) < k
    return q[keep], r[keep], best[keep]


def _dots(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Double-precision dot products of chosen pairs, a bounded number at a time."""
    out = np.empty(len(q))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        out[part] = np.einsum("ij,ij->i", queries[q[part]], rows[r[part]], dtype=np.float64)
    return out


def _rank(sorted_groups: np.ndarray, n_groups: int) -> np.ndarray:
    """Place from 0 within each group of a sorted array."""
    starts = np.searchsorted(sorted_groups, np.arange(n_groups))
    return np.arange(len(sorted_groups)) - starts[sorted_groups]


def bank_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Bank rows in the precision they are stored in."""
    wide = pa.types.is_list(column.type) and pa.types.is_float64(column.type.value_type)
    return list_matrix(column, np.float64 if wide else np.float32)


def finite_rows(batch: pa.RecordBatch, matrix: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Without the rows that hold a NaN or an infinity: they have no place in any ranking."""
    good = np.isfinite(matrix).all(axis=1)
    return (batch, matrix) if good.all() else (batch.filter(pa.array(good)), matrix[good])


def _hits_batch(q_ids, row_ids, species, sims) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q_ids, pa.int64()), pa.array(row_ids, pa.int64()), species, pa.array(sims, pa.float64())],
        names=["query_id", "row_id", "species", "sim"],
    )


def _string_array(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.string())


def _scan_bank(rows: pa.Table, bank: DataFrame, k: int) -> DataFrame:
    """Few queries: they travel to the bank. The bank is read once and never shuffled."""
    shared = bank.sparkSession.sparkContext.broadcast(
        (rows.column("query_id").to_numpy(), list_matrix(rows.column("q_vec")))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_matrix = shared.value
        # The running best of all queries, and per query the similarity a new row has to reach.
        best_q, best_row = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        best_sim, best_species = np.zeros(0), pa.array([], pa.string())
        floor: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch, matrix = finite_rows(batch, bank_matrix(batch.column("vec")))
            row_ids = batch.column("row_id").to_numpy()
            species = _string_array(batch.column("species"))
            parts = [(best_q, best_row, best_sim, best_species)]
            for start in range(0, len(q_ids), _QUERY_CHUNK):
                stop = start + _QUERY_CHUNK
                limit = None if floor is None else floor[start:stop]
                q, r, sim = top_k_hits(q_matrix[start:stop], matrix, row_ids, k, limit)
                parts.append((q + start, row_ids[r], sim, species.take(pa.array(r))))
            q, row, sim = (np.concatenate([p[i] for p in parts]) for i in range(3))
            names = pa.concat_arrays([p[3] for p in parts])
            order = np.lexsort((row, -sim, q))
            place = _rank(q[order], len(q_ids))
            order, place = order[place < k], place[place < k]
            best_q, best_row, best_sim = q[order], row[order], sim[order]
            best_species = names.take(pa.array(order))
            floor = np.full(len(q_ids), -np.inf)
            floor[best_q[place == k - 1]] = best_sim[place == k - 1]
        if len(best_q):
            yield _hits_batch(q_ids[best_q], best_row, best_species, best_sim)

    return bank.mapInArrow(scan, _HITS)


class PivotTree:
    """Pivots in two levels: a row goes to its nearest top pivot and, below that, to the nearest of its leaves.

    So there may be many more cells than pivots a row is held against. Any assignment gives right results, as the radius of a
    cell is that of the rows it got.
    """

    def __init__(self, sample: np.ndarray, tops: int):
        _, first = np.unique(sample, axis=0, return_index=True)
        sample = sample[np.sort(first)]
        self.tops = sample[:tops]
        parent = np.concatenate([self._nearest(self.tops, sample[i : i + BLOCK_ROWS]) for i in range(0, len(sample), BLOCK_ROWS)])
        order = np.argsort(parent, kind="stable")
        self.leaves = sample[order]
        self.first = np.searchsorted(parent[order], np.arange(len(self.tops) + 1))

    @staticmethod
    def _nearest(pivots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return ((pivots**2).sum(axis=1)[None, :] - 2.0 * (rows @ pivots.T)).argmin(axis=1)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        top = self._nearest(self.tops, rows)
        cell = self.first[top]
        for t in np.unique(top).tolist():
            own = self.leaves[self.first[t] : self.first[t + 1]]
            if len(own) > 1:
                at = np.flatnonzero(top == t)
                cell[at] = self.first[t] + self._nearest(own, rows[at])
        return np.minimum(cell, len(self.leaves) - 1)


def _nearest_pivot(bank: DataFrame, tree: PivotTree) -> DataFrame:
    """Add to every bank row its cell and the distance to the pivot of that."""
    shared = bank.sparkSession.sparkContext.broadcast(tree)
    schema = f"row_id long, species string, vec {bank.schema['vec'].dataType.simpleString()}, cell int, distance double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch, matrix = finite_rows(batch, list_matrix(batch.column("vec")))
            cell = own.assign(matrix) if batch.num_rows else np.zeros(0, np.int64)
            distance = np.linalg.norm(matrix - own.leaves[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"),
                    _string_array(batch.column("species")),
                    batch.column("vec"),
                    pa.array(cell, pa.int32()),
                    pa.array(distance),
                ],
                names=["row_id", "species", "vec", "cell", "distance"],
            )

    return bank.mapInArrow(assign, schema)


@dataclass
class Cells:
    """Leaves of the pivot tree that hold rows, dealt out to shards of bounded size.

    Neighbouring small cells share a shard, a large one spans several. A slot is a cell in a shard; slots are sorted by shard.
    """

    tree: PivotTree
    radius: np.ndarray  # by cell; below 0 without rows
    sizes: np.ndarray  # by cell
    first: np.ndarray  # by cell: its first shard, and how many shards it spans
    parts: np.ndarray
    slot_shard: np.ndarray
    slot_cell: np.ndarray
    shard_rows: np.ndarray  # by shard

    @classmethod
    def dealt(cls, tree: PivotTree, radius: np.ndarray, sizes: np.ndarray, most: int) -> Cells:
        first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        slots: list[tuple[int, int]] = []
        held: list[int] = []
        open_ = False
        for cell in np.flatnonzero(sizes).tolist():
            n = int(sizes[cell])
            parts[cell] = -(-n // most)
            if not open_ or parts[cell] > 1 or held[-1] + n > most:
                first[cell] = len(held)
                held += [-(-n // parts[cell])] * parts[cell]
            else:
                first[cell] = len(held) - 1
                held[-1] += n
            open_ = parts[cell] == 1
            slots += [(first[cell] + i, cell) for i in range(parts[cell])]
        shards, cells = np.array(slots, np.int64).reshape(-1, 2).T
        return cls(tree, radius, sizes, first, parts, shards, cells, np.array(held, np.int64))

    def seen(self, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which cells can hold one of a query's k best rows, a floor for the k-th best, and the nearest pivot.

        A row x of a cell with pivot c satisfies q.x <= q.c + |q| * radius. The pivots are bank rows, so
        the k-th best pivot is a floor for the k-th best row; a cell below that floor, or without rows, is skipped.
        """
        sims = matrix @ self.tree.leaves.T
        if sims.shape[1] >= k:
            floor = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        else:
            floor = np.full(len(sims), -np.inf)
        ceiling = sims + np.linalg.norm(matrix, axis=1)[:, None] * self.radius[None, :]
        return (ceiling >= floor[:, None] - _LOOSE) & (self.radius >= 0), floor, sims.argmax(axis=1)

    def shards_seen(self, seen: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(seen[:, self.slot_cell], np.searchsorted(self.slot_shard, np.arange(len(self.shard_rows))), axis=1)


def _cells(bank: DataFrame, bank_rows: int, block_rows: int, pivots: int, shard_values: int) -> Cells:
    n_leaves = int(min(pivots * LEAVES, max(1, -(-bank_rows // block_rows))))
    # Bounded: at most pivots * LEAVES rows reach the driver, a row is held against pivots + about LEAVES of them.
    sample = bank.orderBy(F.xxhash64("row_id"), "row_id").limit(n_leaves).select("vec").toArrow()
    rows = list_matrix(sample.column("vec"))
    rows = rows[np.isfinite(rows).all(axis=1)]
    tree = PivotTree(rows if len(rows) else np.zeros((1, rows.shape[1])), pivots)
    radius, sizes = np.full(len(tree.leaves), -1.0), np.zeros(len(tree.leaves), np.int64)
    near = _nearest_pivot(bank, tree)
    extents = near.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    for row in extents.collect():  # one row per leaf
        radius[row["cell"]], sizes[row["cell"]] = row["radius"], row["n"]
    return Cells.dealt(tree, radius, sizes, max(1, shard_values // max(1, rows.shape[1])))


def compared_share(queries: DataFrame, bank: DataFrame, k: int = TOP_K, block_rows: int = BLOCK_ROWS, pivots: int = MAX_PIVOTS) -> float:
    """The part of all pairs of ``queries`` (``query_id, vec``) and bank rows that the cells leave to be compared."""
    asked = queries.select("query_id", as_double(F.col("vec")).alias("q_vec"))
    bank = bank.select("row_id", "species", "vec")
    rows = bank.count()
    shared = bank.sparkSession.sparkContext.broadcast(_cells(bank, rows, block_rows, pivots, SHARD_VALUES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROUTE_CHUNK):
                seen = shared.value.seen(list_matrix(batch.column("q_vec").slice(at, _ROUTE_CHUNK)), k)[0]
                pairs = seen.sum(axis=0) @ shared.value.sizes
                yield pa.RecordBatch.from_pydict({"queries": [len(seen)], "pairs": [int(pairs)]})

    found = asked.mapInArrow(count, "queries long, pairs long").agg(F.sum("queries").alias("n"), F.sum("pairs").alias("pairs")).first()
    return (found["pairs"] or 0) / max(1, rows * (found["n"] or 0))


def _salt(ids: pa.Array, parts: np.ndarray) -> np.ndarray:
    """A number below ``parts`` that depends on the id only."""
    mixed = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _bytes_array(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _from_bytes(column: pa.Array, dtype: str) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), -1)


#: One layout for both sides (0: bank rows, 1: queries), so that a shard comes before the queries that meet it.
_MEETING = "group long, side int, cell int, id long, species string, body binary, floor double, blocks int"


def _meeting(group, side: int, cell, ids, species, body, floor, blocks) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(group, pa.int64()), pa.array(np.full(n, side), pa.int32()), pa.array(cell, pa.int32()), ids.cast(pa.int64()),
            pa.nulls(n, pa.string()) if species is None else species, body,
            pa.nulls(n, pa.float64()) if floor is None else pa.array(floor, pa.float64()), pa.array(blocks, pa.int32()),
        ],
        names=[f.split()[0] for f in _MEETING.split(", ")],
    )


class Shard:
    """Rows of some cells, sorted by cell, in a task; queries pass by in chunks."""

    def __init__(self, rows: pa.Table, cells: Cells, dtype: str, k: int):
        self.k = k
        self.matrix = np.concatenate([_from_bytes(c, dtype) for c in rows.column("body").chunks])
        self.ids, self.species = rows.column("id").combine_chunks(), rows.column("species").combine_chunks()
        self.order = self.ids.fill_null(np.iinfo(np.int64).min).to_numpy()  # a missing id comes first, as in Spark
        own, self.starts = np.unique(rows.column("cell").to_numpy(), return_index=True)
        self.sizes = np.diff(np.append(self.starts, rows.num_rows))
        self.centres, self.radius = cells.tree.leaves[own], cells.radius[own]

    def best(self, asked: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the k best rows; ``least`` is a floor for the k-th best of the whole bank.

        Cells are visited from the most promising one on, some thousand rows at a time; what they gave k times shuts out others.
        """
        ceiling = asked @ self.centres.T + np.linalg.norm(asked, axis=1)[:, None] * self.radius[None, :]
        floor, full = least.copy(), np.zeros(len(asked), bool)
        q, row, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        todo = np.argsort(-ceiling.max(axis=0), kind="stable")
        while len(todo):
            wanted = ceiling[:, todo] >= floor[:, None] - _LOOSE
            open_ = wanted.any(axis=0)
            todo, wanted = todo[open_], wanted[:, open_]
            n = max(1, int(np.searchsorted(np.cumsum(self.sizes[todo]), BLOCK_ROWS, side="right")))
            who = np.flatnonzero(wanted[:, :n].any(axis=1))
            if not len(who):
                break
            at = np.concatenate([np.arange(self.starts[c], self.starts[c] + self.sizes[c]) for c in todo[:n].tolist()])
            todo = todo[n:]
            for start in range(0, len(at), BLOCK_ROWS):
                part = at[start : start + BLOCK_ROWS]
                rows, ids = self.matrix[part], self.order[part]
                found = [(q, row, sim)]
                for some, limit in ((who[full[who]], True), (who[~full[who]], False)):
                    if len(some):
                        a, b, s = top_k_hits(asked[some], rows, ids, self.k, floor[some] if limit else None)
                        found.append((some[a], part[b], s))
                q, row, sim = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.lexsort((self.order[row], -sim, q))
                place = _rank(q[order], len(asked))
                order, place = order[place < self.k], place[place < self.k]
                q, row, sim = q[order], row[order], sim[order]
                last = place == self.k - 1
                full[q[last]] = True
                floor[q[last]] = np.maximum(least[q[last]], sim[last])
        good = sim >= least[q] - _LOOSE
        return q[good], row[good], sim[good]

    def hits(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, queries.num_rows, _QUERY_CHUNK):
            chunk = queries.slice(at, _QUERY_CHUNK)
            q, row, sim = self.best(_from_bytes(chunk.column("body"), "<f8"), chunk.column("floor").to_numpy())
            row = pa.array(row)
            yield _hits_batch(chunk.column("id").take(pa.array(q)), self.ids.take(row), self.species.take(row), sim)


def _join_cells(
    queries: DataFrame, bank: DataFrame, bank_rows: int, k: int, block_rows: int, pivots: int, shard_values: int
) -> DataFrame:
    """Many queries: a query travels once to every shard that has a cell it must see; there it meets that shard's cells.

    A task holds one shard and lets a block of its queries pass by. Blocks are as large as a task's work allows, since each brings
    a copy of the shard.
    """
    spark = bank.sparkSession
    cells = _cells(bank, bank_rows, block_rows, pivots, shard_values)
    if not len(cells.shard_rows):
        return spark.createDataFrame([], _HITS)
    wide = bank.schema["vec"].dataType.simpleString() == "array<double>"
    dtype = "<f8" if wide else "<f4"
    shared = spark.sparkContext.broadcast(cells)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROUTE_CHUNK):
                batch = whole.slice(at, _ROUTE_CHUNK)
                matrix = list_matrix(batch.column("q_vec"))
                mask, floor, home = shared.value.seen(matrix, k)
                yield batch, matrix, shared.value.shards_seen(mask), floor, home

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.shard_rows), np.int64)
        for _, _, mask, _, _ in seen(batches):
            total += mask.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"shard": np.arange(len(total)), "n": total})

    asking = np.zeros(len(cells.shard_rows), np.int64)
    for row in queries.mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        asking[row["shard"]] = row["n"]
    pairs = asking * cells.shard_rows
    few = np.minimum(-(-pairs // FEW_PAIRS), -(-PARALLEL // len(pairs)))
    blocks = np.maximum(1, np.maximum(-(-pairs // MOST_PAIRS), few))
    start = np.append(0, np.cumsum(blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, matrix, mask, floor, home in seen(batches):
            q, shard = np.nonzero(mask)
            if len(q):
                ids = batch.column("query_id").take(pa.array(q))
                group = start[shard] + _salt(ids, blocks[shard])
                yield _meeting(group, 1, home[q], ids, None, _bytes_array(matrix[q].astype("<f8")), floor[q], np.ones(len(q)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            batch, matrix = finite_rows(batch, bank_matrix(batch.column("vec"))) if batch.num_rows else (batch, None)
            if batch.num_rows:
                cell = own.tree.assign(matrix.astype(np.float64))
                shard = own.first[cell] + _salt(batch.column("row_id"), own.parts[cell])
                yield _meeting(
                    start[shard], 0, cell, batch.column("row_id"), _string_array(batch.column("species")),
                    _bytes_array(matrix.astype(dtype)), None, blocks[shard],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, shard = None, [], None
        for batch in batches:
            key = batch.column("group").to_numpy() * 2 + batch.column("side").to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if key[a] // 2 != group:
                    group, held, shard = key[a] // 2, [], None
                part = batch.slice(a, b - a)
                if key[a] % 2 == 0:
                    held.append(part)
                elif held or shard:
                    if shard is None:
                        shard, held = Shard(pa.Table.from_batches(held), shared.value, dtype, k), []
                    yield from shard.hits(part)

    copies = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = bank.mapInArrow(place, _MEETING).withColumn("copy", copies).withColumn("group", F.col("group") + F.col("copy")).drop("copy")
    both = queries.mapInArrow(route, _MEETING).unionByName(rows).drop("blocks")
    tasks = int(min(start[-1], MOST_TASKS))
    dealt = both.repartitionById(tasks, F.pmod(F.col("group"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("group", "side", "cell").mapInArrow(meet, _HITS)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """Global top-k of block-local hits; Spark prunes to k per query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("row_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    bank: DataFrame,
    k: int = TOP_K,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
    pivots: int = MAX_PIVOTS,
    shard_values: int = SHARD_VALUES,
) -> DataFrame:
    """The k bank rows with the largest dot product, per query.

    queries: ``query_id long, vec array``; bank: ``row_id long, species string, vec`` (an array, or
    packed fp32 bytes). Returns ``query_id, row_id, species, sim, rank``. Rows with a null vector or a
    value that is not finite are ignored; such a query has no hits. Vectors are used as they are: normalising is a step of its own. A bank smaller than k
    gives what it has.

    Up to ``broadcast_rows`` queries travel to the bank. The size is checked by fetching no more than
    one row beyond that bound; larger query sets take the block path and never reach the driver: cells of about ``block_rows``
    bank rows in shards of at most ``shard_values`` values.
    """
    asked = queries.filter(F.col("vec").isNotNull()).select("query_id", as_double(F.col("vec")).alias("q_vec"))
    bank = bank.filter(F.col("vec").isNotNull()).select("row_id", F.col("species").cast("string").alias("species"), "vec")
    few = asked.limit(broadcast_rows + 1).toArrow()
    if few.num_rows <= broadcast_rows:
        return top_k(_scan_bank(few, bank, k), k)
    return top_k(_join_cells(asked, bank, bank.count(), k, block_rows, pivots, shard_values), k)
