"""Exact top-k search by columnar branch and bound.

Vectors are turned to integers and cut into blocks held dimension by dimension. A block of queries meets a block of
candidates as follows: inner products are accumulated one block of dimensions after another; after each, what the
remaining dimensions can still add is at most the product of the remaining lengths (Cauchy-Schwarz), so candidates
whose bound stays below a query's k-th best score so far are dropped and the others are moved together. The dimensions
with the most mass come first.

Queries and candidates are dealt out on a grid of cells, each with a bounded group of queries and a share of the
candidates. A cell keeps k rows per query; Spark ranks those of all cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecbank.llm.batches import record

K = 10
SCALE = 1024
DIM_BLOCK = 16
QUERY_BLOCK = 128
CANDIDATE_BLOCK = 2048
#: Bytes of query vectors in a cell, and rows of candidates.
CELL_QUERY_BYTES = 8 << 20
CELL_CANDIDATES = 1 << 16
EXACT = float(1 << 53)
HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & good


def quantized(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, the component taken as double; whole numbers kept in doubles."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """List values as a matrix; shorter vectors are filled with zeros, which add nothing."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    matrix = np.zeros((len(lengths), width))
    matrix[np.arange(width)[None, :] < lengths[:, None]] = flat
    return matrix


class Queries:
    """Queries of a cell with their k best rows so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.order = np.argsort(-(matrix**2).sum(axis=0), kind="stable")
        self.ids, self.matrix, self.k = ids, matrix[:, self.order], k
        self.rest = remaining(self.matrix)
        self.scores = np.full((len(ids), k), -np.inf)
        self.hits = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def merge(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        every, marks = np.r_[self.scores[query], scores], np.r_[self.hits[query], ids]
        best = np.lexsort((marks, -every))[: self.k]
        self.scores[query], self.hits[query] = every[best], marks[best]

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Let a block of candidates compete. ``matrix``: one row per candidate."""
        columns = np.ascontiguousarray(matrix[:, self.order].T)  # vertical: one row per dimension
        rest = remaining(columns.T)
        dims = len(columns)
        for at in range(0, len(self.ids), QUERY_BLOCK):
            block = slice(at, at + QUERY_BLOCK)
            first = min(DIM_BLOCK, dims)
            partial = self.matrix[block, :first] @ columns[:first]
            bound = partial + np.outer(self.rest[block, first], rest[:, first])
            # Bounds are floating point; the allowance covers their rounding.
            alive = bound * (1 + np.sign(bound) * 1e-9) + 1e-6 >= self.scores[block, -1:]
            alive &= ids[None, :] != self.ids[block, None]
            for i in np.flatnonzero(alive.any(axis=1)):
                query, kept = at + i, np.flatnonzero(alive[i])
                score = partial[i, kept]
                for dim in range(first, dims, DIM_BLOCK):
                    end = min(dim + DIM_BLOCK, dims)
                    score = score + self.matrix[query, dim:end] @ columns[dim:end, kept]
                    if end < dims:
                        bound = score + self.rest[query, end] * rest[kept, end]
                        stay = bound * (1 + np.sign(bound) * 1e-9) + 1e-6 >= self.scores[query, -1]
                        kept, score = kept[stay], score[stay]
                stay = score >= self.scores[query, -1]
                if stay.any():
                    kept, score = kept[stay], score[stay]
                    if len(score) > self.k:  # only what reaches the k-th score of this block can stay
                        reach = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                        kept, score = kept[reach], score[reach]
                    self.merge(query, ids[kept], score)

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(np.isfinite(self.scores))
        return record(HIT, {"query_id": self.ids[query], "vec_id": self.hits[query, place], "score": self.scores[query, place].astype(np.int64)})


def remaining(matrix: np.ndarray) -> np.ndarray:
    """Length of each row from every dimension on (one column more than dimensions; the last is zero)."""
    mass = np.zeros((len(matrix), matrix.shape[1] + 1))
    mass[:, :-1] = np.cumsum(matrix[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(mass)


def search(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """The ``k`` best candidates of each query by integer inner product: ``query_id, rank, vec_id, score``.

    Both tables hold ``vec_id, vec``. Components become floor(scale * x). Candidates with the query's own vec_id take no part;
    ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components, and rows without id,
    take no part. Vectors of unequal length are compared as if the shorter had zeros at its end. Of queries that repeat
    an id the smallest vector counts; candidates that repeat an id all compete. An empty table on either side gives an
    empty result. Further columns are not looked at. Scores beyond 2^53 would not be exact: such vectors raise an error.
    """
    spark = queries.sparkSession
    asked = queries.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = asked.select("vec_id", quantized(F.col("vec"), scale).alias("vec"))
    offered = candidates.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).select("vec_id", quantized(F.col("vec"), scale).alias("vec"))
    sizes = F.max(F.size("vec")).alias("width"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("mass"), F.count("*").alias("n")
    width, n_asked, n_offered = 0, 0, 0
    mass = 1.0
    for df, side in ((asked, 0), (offered, 1)):
        row = df.agg(*sizes).first()
        width, mass = max(width, row["width"] or 0), mass * (row["mass"] or 0)
        n_asked, n_offered = (row["n"], n_offered) if side == 0 else (n_asked, row["n"])
    if mass**0.5 >= EXACT:
        raise ValueError("inner products would leave the range of exact integers")
    per_group = max(1, CELL_QUERY_BYTES // (8 * max(width, 1)))
    groups, shares = max(1, -(-n_asked // per_group)), max(1, -(-n_offered // CELL_CANDIDATES))
    # Small searches still use all tasks: shares are at least as many as shuffle partitions allow, down to one block.
    shares = max(shares, min(int(spark.conf.get("spark.sql.shuffle.partitions")) // groups, -(-n_offered // CANDIDATE_BLOCK)), 1)
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("s", cells(shares))
    right = offered.withColumn("s", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shares)).cast("int")).withColumn("g", cells(groups))
    names = ["g", "s", "side", "vec_id", "vec"]
    both = left.withColumn("side", F.lit(0)).select(*names).unionByName(right.withColumn("side", F.lit(1)).select(*names))
    parts = min(groups * shares, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups))
    dealt = both.repartition(parts, "g", "s").sortWithinPartitions("g", "s", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found, ids, rows = None, None, [], []
        for batch in batches:
            g, s, side, marks = (batch.column(i).to_numpy() for i in range(4))
            matrix = rows_of(batch.column(4), width)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(s) != 0) | (np.diff(side) != 0)) + 1
            for at, end in zip(np.r_[0, cuts], np.r_[cuts, len(g)], strict=True):
                if cell != (g[at], s[at]):
                    if found:
                        yield found.rows()
                    cell, found, ids, rows = (g[at], s[at]), None, [], []
                if side[at] == 0:
                    ids.append(marks[at:end])
                    rows.append(matrix[at:end])
                    continue
                if ids:  # the queries of a cell come first
                    found, ids, rows = Queries(np.concatenate(ids), np.concatenate(rows), k), [], []
                if found:
                    for start in range(at, end, CANDIDATE_BLOCK):
                        stop = min(start + CANDIDATE_BLOCK, end)
                        found.meet(marks[start:stop], matrix[start:stop])
        if found:
            yield found.rows()

    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
