"""Hard-negative mining over cover trees of norm-augmented candidates.

Vectors are whole numbers. A candidate x gets one more component, sqrt(M - |x|²) with M the largest squared norm, so all lie on
one sphere and the inner product with an anchor q is largest where the augmented candidate is nearest to (q, 0). A tree is
built over each bounded share of the candidates: a node's points lie within its covering radius around its centre, which is
halved from level to level. An anchor's inner product with a node's points thus lies within radius times |q| of that with
its centre. A search descends best bound first, leaves out nodes that cannot reach the k-th best score so far, nodes wholly
outside the asked window of scores and nodes without a fitting label, and verifies the points of leaves exactly.

Candidates are shuffled once, to their share; anchors travel to all shares. A share keeps k rows per anchor or window, and
Spark ranks those of all shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbank.llm.batches import record
from vecbank.llm.topk import quantized, rows_of, usable
from vecbank.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Bounds of the score of a negative, in hundredths of the positive's.
LOW, HIGH = 80, 100
#: Candidates in a share, anchors that meet a share in one task, and points in a leaf.
SHARE, GROUP, LEAF = 1 << 15, 1 << 17, 48
LEVELS = 24
#: Nodes taken from the front at once.
BEAM = 64
EXACT = float(1 << 53)


class CoverTree:
    """Points sorted so that every node is a run of them; nodes as arrays, children of a node one after another."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, leaf: int = LEAF):
        squares = (matrix**2).sum(axis=1)
        self.most = float(squares.max())
        extra = np.sqrt(self.most - squares)  # the component that puts all points on one sphere

        def distances(some: np.ndarray, centres: np.ndarray) -> np.ndarray:
            """Between augmented points; the part of the whole numbers is exact."""
            square = squares[some, None] + squares[centres] - 2 * (matrix[some] @ matrix[centres].T)
            return np.sqrt(square + (extra[some, None] - extra[centres]) ** 2)

        order = np.argsort(ids, kind="stable")
        root = int(order[0])
        nodes = [(0, len(ids), root, float(distances(order, order[:1]).max()))]  # first point, end, centre, radius
        children = [(0, 0)]
        points = np.empty(len(ids), np.int64)
        waiting = [(order, root, nodes[0][3], 0, 0)]  # members, centre, radius, level, first place
        for members, centre, radius, level, first in waiting:  # grows while it is read
            points[first : first + len(members)] = members
            if len(members) <= leaf or radius == 0 or level == LEVELS:
                children.append((0, 0))
                continue
            begin, start = first, len(nodes)
            for own, taken, reach in covers(np.r_[centre, members[members != centre]], radius / 2, distances):
                nodes.append((begin, begin + len(taken), own, reach))
                waiting.append((taken, own, reach, level + 1, begin))
                begin += len(taken)
            children.append((start, len(nodes)))
        del children[0]
        self.ids, self.labels, self.matrix = ids[points], labels[points], matrix[points]
        first, end, centre, radius = (np.array(x) for x in zip(*nodes, strict=True))
        self.first, self.end, self.centres, self.radius = first, end, matrix[centre], radius * (1 + 1e-9)
        self.child = np.array(children, np.int64)
        self.low_label = np.minimum.reduceat(self.labels, first)
        self.high_label = np.maximum.reduceat(self.labels, first)
        # reduceat runs to the next start; nodes are runs of their own length, so they are taken again one by one where that differs.
        for n in np.flatnonzero(np.r_[first[1:], len(points)] != end):
            own = self.labels[first[n] : end[n]]
            self.low_label[n], self.high_label[n] = own.min(), own.max()

    def best(self, anchor: int, vec: np.ndarray, label: int, same: bool, low: float, high: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best points of the same or another label with low <= score <= high, without the anchor itself."""
        length = float(np.sqrt(vec @ vec)) * (1 + 1e-9)
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        front = np.zeros(1, np.int64)
        bound = np.array([np.inf])
        floor = low
        while len(front):
            if len(front) > BEAM:
                turn = np.argpartition(-bound, BEAM)
                now, rest = turn[:BEAM], turn[BEAM:]
            else:
                now, rest = np.arange(len(front)), np.zeros(0, np.int64)
            nodes, front, bound = front[now], front[rest], bound[rest]
            inner = self.child[nodes, 1] > self.child[nodes, 0]
            leaves, inner = nodes[~inner], nodes[inner]
            if len(leaves):
                points = spread(self.first[leaves], self.end[leaves])
                fits = (self.labels[points] == label) == same
                points = points[fits & (self.ids[points] != anchor)]
                score = self.matrix[points] @ vec
                good = (score >= floor) & (score <= high)
                ids, scores = np.r_[ids, self.ids[points[good]]], np.r_[scores, score[good]]
                if len(ids) > k:
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
                if len(ids) == k:
                    floor = max(floor, float(scores.min()))
            if len(inner):
                kids = spread(self.child[inner, 0], self.child[inner, 1])
                if same:
                    kids = kids[(self.low_label[kids] <= label) & (self.high_label[kids] >= label)]
                else:
                    kids = kids[(self.low_label[kids] != label) | (self.high_label[kids] != label)]
                middle = self.centres[kids] @ vec
                slack = self.radius[kids] * length + 1e-6 * (1 + np.abs(middle))
                stay = (middle + slack >= floor) & (middle - slack <= high)
                front, bound = np.r_[front, kids[stay]], np.r_[bound, (middle + slack)[stay]]
            stay = bound >= floor  # a tie at the k-th score may still win by its id
            front, bound = front[stay], bound[stay]
        return ids, scores


def covers(members: np.ndarray, reach: float, distances: Callable) -> Iterator[tuple[int, np.ndarray, float]]:
    """(centre, members within reach of it, the farthest of them): the first member left is the next centre.

    Distances are taken to the first members left at once; those covered by one before them are no centres.
    """
    while len(members):
        away = distances(members, members[:BEAM])
        near = away <= reach
        np.fill_diagonal(near, True)
        taken_by = np.full(len(members), -1)
        for n in range(near.shape[1]):
            if taken_by[n] < 0:
                own = near[:, n] & (taken_by < 0)
                taken_by[own] = n
                yield int(members[n]), members[own], float(away[own, n].max())
        members = members[taken_by < 0]


def spread(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first..end, one range after another."""
    sizes = end - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


HIT = pa.schema([("anchor_id", pa.int64()), ("window", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])
Asked = Callable[[CoverTree, int, np.ndarray, int, list], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def in_shares(anchors: DataFrame, candidates: DataFrame, shares: int, groups: int, width: int, ask: Asked) -> DataFrame:
    """Let every anchor (``vec_id, label, vec, windows``) ask the tree of every share: ``anchor_id, window, found_id, score``."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda n, salt: F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(n)).cast("int")
    names = ["s", "g", "side", "vec_id", "label", "vec", "windows"]
    left = candidates.withColumns({"s": hashed(shares, 0), "side": F.lit(0), "windows": F.array().cast("array<struct<id:bigint,score:double>>")})
    right = anchors.withColumns({"g": hashed(groups, 1), "side": F.lit(1)})
    both = left.withColumn("g", every(groups)).select(*names).unionByName(right.withColumn("s", every(shares)).select(*names))
    spark = anchors.sparkSession
    parts = min(shares * groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shares))
    dealt = both.repartition(parts, "s", "g").sortWithinPartitions("s", "g", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree, held = None, None, []
        for batch in batches:
            s, g, side, ids, labels = (batch.column(i).to_numpy() for i in range(5))
            matrix, windows = rows_of(batch.column(5), width), batch.column(6)
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(g) != 0) | (np.diff(side) != 0)) + 1
            for at, end in zip(np.r_[0, cuts], np.r_[cuts, len(s)], strict=True):
                if cell != (s[at], g[at]):
                    cell, tree, held = (s[at], g[at]), None, []
                if side[at] == 0:  # the candidates of a cell come first
                    held.append((ids[at:end], labels[at:end], matrix[at:end]))
                    continue
                if held:
                    tree, held = CoverTree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if tree is None:
                    continue
                out = [(int(ids[i]), window, found, score) for i in range(at, end)
                       for window, found, score in ask(tree, int(ids[i]), matrix[i], int(labels[i]), windows[i].as_py())]
                if out:
                    sizes = [len(o[2]) for o in out]
                    yield record(HIT, {
                        "anchor_id": np.repeat([o[0] for o in out], sizes), "window": np.repeat([o[1] for o in out], sizes),
                        "found_id": np.concatenate([o[2] for o in out]), "score": np.concatenate([o[3] for o in out]).astype(np.int64),
                    })

    return dealt.mapInArrow(run, "anchor_id long, window long, found_id long, score long")


def ranked(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(anchors: DataFrame, rows: DataFrame, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors among ``rows`` (``vec_id, label, vec``).

    Components become floor(scale * x); scores are integer inner products, ties go to the smaller vec_id. An anchor's positives are
    its best rows of the same label, its own id excepted. For each, the best rows of other labels follow whose score times 100 lies
    between ``low`` and ``high`` times the positive's score; a negative positive's window is empty. Rows with null id, label or
    vector, or with null or non-finite components, take no part on either side. Vectors of unequal length are compared as if
    the shorter had zeros at its end. Of anchors that repeat an id the smallest (label, vector) counts; other rows that repeat an
    id all compete, but exact repeats count once. Anchors without positives or negatives give no rows; an empty table gives an
    empty result, further columns are not looked at. Scores beyond 2^53 would not be exact: such vectors raise an error.
    """
    spark = rows.sparkSession
    taking_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))
    fields = "vec_id", F.col("label").cast("long").alias("label"), quantized(F.col("vec"), scale).alias("vec")
    offered = materialize(rows.filter(taking_part).select(*fields).distinct(), "candidates")
    asked = anchors.filter(taking_part).select(*fields).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x"))
    asked = materialize(asked.select("vec_id", "x.label", "x.vec"), "anchors")
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    sizes = [df.agg(F.max(F.size("vec")).alias("width"), F.max(length).alias("mass"), F.count("*").alias("n")).first() for df in (asked, offered)]
    width = max(s["width"] or 0 for s in sizes)
    if max(s["mass"] or 0.0 for s in sizes) * max(scale, 100) >= EXACT:
        raise ValueError("inner products would leave the range of exact integers")
    groups = max(1, -(-sizes[0]["n"] // GROUP))
    shares = max(1, -(-sizes[1]["n"] // SHARE))
    # Small searches still use all tasks, with shares of some thousand candidates.
    shares = max(shares, min(int(spark.conf.get("spark.sql.shuffle.partitions")) // groups, -(-sizes[1]["n"] // (SHARE // 8))))

    def same_label(tree: CoverTree, anchor: int, vec: np.ndarray, label: int, _: list) -> Iterator[tuple]:
        yield (0, *tree.best(anchor, vec, label, True, -np.inf, np.inf, positives))

    def other_labels(tree: CoverTree, anchor: int, vec: np.ndarray, label: int, windows: list) -> Iterator[tuple]:
        for w in windows:
            # Whole numbers: the smallest score with 100 * score >= low * positive, and the largest the other way.
            least, most = -(-low * int(w["score"]) // 100), high * int(w["score"]) // 100
            if least <= most:
                yield (w["id"], *tree.best(anchor, vec, label, False, least, most, negatives))

    none = F.array().cast("array<struct<id:bigint,score:double>>")
    first = in_shares(asked.withColumn("windows", none), offered, shares, groups, width, same_label)
    found = materialize(ranked(first, ["anchor_id"], positives).select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth")), "positives")
    # At most ``positives`` windows an anchor; equal ids among positives share one window each by their place.
    windows = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("nth").cast("long").alias("id"), F.col("positive_score").cast("double").alias("score"))).alias("windows")
    )
    second = in_shares(asked.join(windows, "vec_id"), offered, shares, groups, width, other_labels)
    mined = ranked(second, ["anchor_id", "window"], negatives).withColumnRenamed("window", "nth")
    return mined.join(found.withColumn("nth", F.col("nth").cast("long")), ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
