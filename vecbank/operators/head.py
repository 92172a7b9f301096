"""Training the projection head and its cosine classifier on frozen features.

Data stays on the executors. Rows fall into buckets by a hash; an epoch is one job, in which every bucket starts from the
shared weights and moments, makes AdamW steps of its own on one mini-batch after another, and hands on where it ended. The
ends are averaged, weighted by rows, in a tree of tasks. Buckets hold a bounded number of mini-batches, so larger tables
have more of them and not longer tasks; a table of one bucket is trained as on a single machine. Buckets, the order
within them and dropout masks do not depend on how the rows are partitioned, nor does the order of sums, so neither does
the result.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbank.functions.vectors import list_matrix
from vecbank.operators.embedding import project
from vecbank.operators.knn import BROADCAST_ROWS
from vecbank.operators.quality import retrieval_accuracy
from vecbank.session import materialize
from vecbank.settings import (
    COSINE_SCALE, HEAD_BATCH, HEAD_DROPOUT, HEAD_EPOCHS, HEAD_LR, HEAD_PATIENCE, HEAD_WEIGHT_DECAY, LABEL_SMOOTHING,
)
from vecbank.sources.files import resolve, write_atomically

NAMES = ("w1", "b1", "w2", "b2", "classes")
_BETA1, _BETA2, _EPSILON = 0.9, 0.999, 1e-8
_TREE_WIDTH = 8
#: Mini-batches that a bucket trains on before its weights are averaged with those of the others.
LOCAL_STEPS = 64

Weights = dict[str, np.ndarray]


def initial_weights(in_dim: int, dim: int, n_classes: int, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)

    def linear(rows: int, cols: int) -> np.ndarray:
        return rng.uniform(-1, 1, (rows, cols)) / np.sqrt(cols)

    reach = np.sqrt(6.0 / (dim + n_classes))
    return {
        "w1": linear(dim, in_dim), "b1": rng.uniform(-1, 1, dim) / np.sqrt(in_dim),
        "w2": linear(dim, dim), "b2": rng.uniform(-1, 1, dim) / np.sqrt(dim),
        "classes": rng.uniform(-reach, reach, (n_classes, dim)),
    }


def loss_and_gradient(
    w: Weights, x: np.ndarray, y: np.ndarray, scale: float = COSINE_SCALE, smoothing: float = LABEL_SMOOTHING
) -> tuple[float, int, Weights]:
    """Mean smoothed cross entropy of a batch, its hits, and the gradient."""
    n, n_classes = len(x), len(w["classes"])
    z1 = x @ w["w1"].T + w["b1"]
    hidden = np.maximum(z1, 0.0)
    z2 = hidden @ w["w2"].T + w["b2"]
    length = np.maximum(np.linalg.norm(z2, axis=1, keepdims=True), 1e-12)
    emb = z2 / length
    class_length = np.maximum(np.linalg.norm(w["classes"], axis=1, keepdims=True), 1e-12)
    unit = w["classes"] / class_length
    logits = scale * emb @ unit.T
    shifted = logits - logits.max(axis=1, keepdims=True)
    log_p = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
    target = np.full((n, n_classes), smoothing / n_classes)
    target[np.arange(n), y] += 1.0 - smoothing
    loss = float(-(target * log_p).sum() / n)

    d_logits = (np.exp(log_p) - target) / n
    d_emb = scale * d_logits @ unit
    d_unit = scale * d_logits.T @ emb
    d_classes = (d_unit - unit * (d_unit * unit).sum(axis=1, keepdims=True)) / class_length
    d_z2 = (d_emb - emb * (d_emb * emb).sum(axis=1, keepdims=True)) / length
    d_z1 = (d_z2 @ w["w2"]) * (z1 > 0)
    gradient = {
        "w1": d_z1.T @ x, "b1": d_z1.sum(axis=0), "w2": d_z2.T @ hidden, "b2": d_z2.sum(axis=0), "classes": d_classes,
    }
    return loss, int((logits.argmax(axis=1) == y).sum()), gradient


@dataclass
class AdamW:
    """Weights with their moments; weight decay is decoupled from the gradient."""

    weights: Weights
    mean: Weights = field(default_factory=dict)
    square: Weights = field(default_factory=dict)
    steps: int = 0

    def __post_init__(self) -> None:
        for moments in (self.mean, self.square):
            for name, value in self.weights.items():
                moments.setdefault(name, np.zeros_like(value))

    def step(self, gradient: Weights, lr: float, weight_decay: float) -> None:
        self.steps += 1
        for name, g in gradient.items():
            self.mean[name] = _BETA1 * self.mean[name] + (1 - _BETA1) * g
            self.square[name] = _BETA2 * self.square[name] + (1 - _BETA2) * g * g
            mean = self.mean[name] / (1 - _BETA1**self.steps)
            square = self.square[name] / (1 - _BETA2**self.steps)
            kept = self.weights[name] * (1 - lr * weight_decay)
            self.weights[name] = kept - lr * mean / (np.sqrt(square) + _EPSILON)

    def pack(self) -> np.ndarray:
        parts = [d[n].ravel() for d in (self.weights, self.mean, self.square) for n in NAMES]
        return np.concatenate(parts)

    def unpacked(self, flat: np.ndarray, steps: int) -> "AdamW":
        out, at = [], 0
        for group in (self.weights, self.mean, self.square):
            values = {}
            for name in NAMES:
                size = group[name].size
                values[name] = flat[at : at + size].reshape(group[name].shape).copy()
                at += size
            out.append(values)
        return AdamW(*out, steps=steps)


_PARTIAL = "part int, n long, loss double, correct long, blob binary"


def _partial(part: int, n: int, loss: float, correct: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([loss], pa.float64()),
         pa.array([correct], pa.int64()), pa.array([flat.tobytes()], pa.large_binary())],
        names=["part", "n", "loss", "correct", "blob"],
    ).cast(pa.schema([("part", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("correct", pa.int64()), ("blob", pa.binary())]))


def _summed(partials: DataFrame, width: int = _TREE_WIDTH) -> DataFrame:
    """Add the buckets' sums in ``width`` groups, each in the order of its buckets, so the driver adds only that many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, numbers, blob = None, np.zeros(3), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] % width != group:
                    if blob is not None:
                        yield _partial(group, int(numbers[0]), float(numbers[1]), int(numbers[2]), blob)
                    group, numbers, blob = row["part"] % width, np.zeros(3), 0.0
                numbers += [row["n"], row["loss"], row["correct"]]
                blob = blob + np.frombuffer(row["blob"])
        if blob is not None:
            yield _partial(group, int(numbers[0]), float(numbers[1]), int(numbers[2]), blob)

    group = F.col("part") % width
    return partials.repartition(width, group).sortWithinPartitions(group, "part").mapInArrow(run, _PARTIAL)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dropout_mask(ids: np.ndarray, width: int, seed: int, rate: float) -> np.ndarray:
    """Which values stay, drawn from a hash of (id, position, seed)."""
    row = _mixed(ids.astype(np.int64).view(np.uint64) ^ _mixed(np.array([seed + 1], np.uint64)))
    draw = _mixed(row[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 >= rate


def bucket_count(n: int, batch: int, local_steps: int = LOCAL_STEPS) -> int:
    """How many buckets of about ``local_steps`` mini-batches ``n`` rows make."""
    return max(1, -(-n // (batch * local_steps)))


def in_order(rows: DataFrame, buckets: int, epoch: int) -> DataFrame:
    """``bucket, id, label, feat`` with the rows of a bucket together, in an order of this epoch."""
    bucket = F.pmod(F.xxhash64("id", "feat"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = rows.select(bucket, "id", "label", "feat").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", F.xxhash64("id", "feat", F.lit(epoch)), "id", "label")


def mini_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, up to ``size`` of its rows) from rows sorted by bucket; only the last of a bucket is smaller."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        own = held.column("bucket").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)]
        at = 0
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            closed = end < len(own)
            while end - start >= size or (closed and start < end):
                taken = min(size, end - start)
                yield int(own[start]), held.slice(start, taken)
                start += taken
            at = start
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield int(held.column("bucket")[0].as_py()), held


def train_epoch(
    rows: DataFrame, state: AdamW, epoch: int, lr: float, buckets: int = 1, batch: int = HEAD_BATCH, dropout: float = HEAD_DROPOUT,
    weight_decay: float = HEAD_WEIGHT_DECAY,
) -> tuple[AdamW, float, float]:
    """One epoch over ``id long, label int, feat array``: (new state, mean loss, accuracy in per cent). One job, whatever the size."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        now, own, n, loss_sum, correct = None, None, 0, 0.0, 0

        def told() -> pa.RecordBatch:
            # Steps are averaged along with weights and moments.
            return _partial(own, n, loss_sum, correct, np.r_[now.pack(), now.steps] * n)

        for bucket, part in mini_batches(batches, batch):
            if bucket != own:
                if now is not None:
                    yield told()
                now, own, n, loss_sum, correct = start.unpacked(start.pack(), start.steps), bucket, 0, 0.0, 0
            x, y = list_matrix(part.column("feat").combine_chunks()), part.column("label").to_numpy()
            if dropout:
                x = x * dropout_mask(part.column("id").to_numpy(), x.shape[1], epoch, dropout) / (1.0 - dropout)
            loss, hits, gradient = loss_and_gradient(now.weights, x, y)
            now.step(gradient, lr, weight_decay)
            n, loss_sum, correct = n + len(y), loss_sum + loss * len(y), correct + hits
        if now is not None:
            yield told()

    sums = _summed(in_order(rows, buckets, epoch).mapInArrow(run, _PARTIAL)).collect()  # _TREE_WIDTH rows
    shared.destroy()
    sums.sort(key=lambda r: r["part"])
    n = sum(r["n"] for r in sums)
    if not n:
        return state, 0.0, 0.0
    flat = np.sum([np.frombuffer(r["blob"]) for r in sums], axis=0) / n
    return state.unpacked(flat[:-1], round(flat[-1])), sum(r["loss"] for r in sums) / n, 100.0 * sum(r["correct"] for r in sums) / n


def _save(path: str, state: AdamW, best: Weights, history: list[dict]) -> None:
    out = io.BytesIO()
    np.savez(
        out, flat=state.pack(), steps=state.steps, history=np.array(json.dumps(history)),
        **{f"now_{n}": state.weights[n] for n in NAMES}, **{f"best_{n}": best[n] for n in NAMES},
    )
    write_atomically(path, [out.getvalue()], "state")


def _load(path: str) -> tuple[AdamW, Weights, list[dict]] | None:
    fs, name = resolve(path)
    if not fs.get_file_info(name).is_file:
        return None
    with fs.open_input_file(name) as f:
        saved = np.load(io.BytesIO(f.read()))
    weights = {n: saved[f"now_{n}"] for n in NAMES}
    state = AdamW(weights).unpacked(saved["flat"], int(saved["steps"]))
    return state, {n: saved[f"best_{n}"] for n in NAMES}, json.loads(str(saved["history"]))


def _embedded(rows: DataFrame, weights: Weights, key: str) -> DataFrame:
    named = rows.select(F.col("id").alias(key), F.col("label").cast("string").alias("species"), "feat")
    return project(named, weights, [key, "species"])


def _class_accuracy(embedded: DataFrame, classes: np.ndarray) -> float:
    """Per cent of rows whose nearest class weight is their label; the class table travels to the rows."""
    shared = embedded.sparkSession.sparkContext.broadcast(
        classes / np.maximum(np.linalg.norm(classes, axis=1, keepdims=True), 1e-12)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = (list_matrix(batch.column("vec")) @ shared.value.T).argmax(axis=1)
                own = np.array(batch.column("species").to_pylist(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)]), pa.array([int((found == own).sum())])], ["n", "hits"])

    sums = embedded.mapInArrow(run, "n long, hits long").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    return 100.0 * (sums["hits"] or 0) / max(sums["n"] or 0, 1)


def train_head(
    train: DataFrame,
    val: DataFrame,
    n_classes: int,
    dim: int = 256,
    epochs: int = HEAD_EPOCHS,
    lr: float = HEAD_LR,
    batch: int = HEAD_BATCH,
    patience: int = HEAD_PATIENCE,
    dropout: float = HEAD_DROPOUT,
    seed: int = 0,
    state_path: str | None = None,
    local_steps: int = LOCAL_STEPS,
) -> tuple[Weights, list[dict]]:
    """Train until ``epochs`` or ``patience`` epochs without a better validation retrieval.

    train and val: ``id long, label int, feat array`` (stored tables: they are read every epoch). ``batch`` is the number of rows
    of one step, ``local_steps`` that of steps between two averages; an epoch is a fixed number of jobs. The partitions of the
    tables do not matter. Returns the best weights and one record per epoch. Without validation rows all epochs run and
    the last one counts. With ``state_path`` a restarted driver resumes after the last whole epoch.
    """
    first = train.select(F.size("feat").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    buckets = bucket_count(train.count(), batch, local_steps)
    n_val = val.count()
    has_val = n_val > 0
    state = AdamW(initial_weights(first["n"], dim, n_classes, seed))
    best, history = state.weights, []
    if state_path:
        saved = _load(state_path)
        if saved:
            state, best, history = saved
    best_score = max((h["score"] for h in history), default=-1.0)
    stale = 0
    for h in reversed(history):
        if h["improved"]:
            break
        stale += 1

    for epoch in range(len(history), epochs):
        if has_val and stale >= patience:
            break
        rate = lr * (1 + np.cos(np.pi * epoch / max(epochs, 1))) / 2
        state, loss, train_acc = train_epoch(train, state, epoch, rate, buckets, batch, dropout)
        val_acc = retrieval = 0.0
        if has_val:
            queries = _embedded(val, state.weights, "query_id")
            bank = _embedded(train, state.weights, "row_id")
            if n_val > BROADCAST_ROWS:  # the block search reads the bank several times
                queries, bank = materialize(queries, "val"), materialize(bank, "train")
            retrieval = retrieval_accuracy(queries, bank).first()["accuracy"]
            val_acc = _class_accuracy(queries, state.weights["classes"])
        score = retrieval if has_val else float(epoch)
        improved = score > best_score
        if improved:
            best_score, best, stale = score, {n: v.copy() for n, v in state.weights.items()}, 0
        else:
            stale += 1
        history.append({
            "epoch": epoch + 1, "lr": float(rate), "loss": float(loss), "train_acc": float(train_acc),
            "val_acc": float(val_acc), "val_retrieval": float(retrieval), "score": float(score), "improved": improved,
        })
        if state_path:
            _save(state_path, state, best, history)
    return best, history
