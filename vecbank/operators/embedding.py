"""Model inference over pictures and feature rows.

The model is a parameter: a function without arguments that loads it (once per task) and returns
``predict(batch) -> (n, dim)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecbank.functions.pictures import augment, model_input, to_rgb
from vecbank.functions.vectors import list_matrix, matrix_list
from vecbank.settings import HEAD_DROPOUT, INFER_CHUNK, INPUT_SIDE, MIN_NORM

Predict = Callable[[np.ndarray], np.ndarray]


def onnx_model(path: str) -> Callable[[], Predict]:
    """An ONNX file as model; every task opens its own single-threaded session."""

    def load() -> Predict:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        session = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch.astype(np.float32)})[0]

    return load


def random_projection_model(in_dim: int, out_dim: int, seed: int = 0) -> Callable[[], Predict]:
    """A seeded linear map with unit-length output: stands in for a trained network."""

    def load() -> Predict:
        weights = np.random.default_rng(seed).standard_normal((in_dim, out_dim)) / np.sqrt(in_dim)

        def predict(batch: np.ndarray) -> np.ndarray:
            out = batch.reshape(len(batch), -1).astype(np.float64) @ weights
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(lengths < MIN_NORM, 1.0, lengths)

        return predict

    return load


def _pictures(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    for image in batch.column("image").to_pylist():
        ok = image is not None and image["height"] > 0 and image["width"] > 0
        yield to_rgb(image["height"], image["width"], image["nChannels"], bytes(image["data"])) if ok else None


def embed_images(
    images: DataFrame, key: str, make_model: Callable[[], Predict], chunk: int = INFER_CHUNK
) -> DataFrame:
    """``key, vec`` per picture; null where the picture is unreadable or its vector is (almost) zero.

    Resizing and inference share one pass, so prepared pictures never leave the task, and only
    ``chunk`` of them exist at a time.
    """
    source = images.select(F.col(key).cast("string").alias(key), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_model()
        for batch in batches:
            vectors: list[np.ndarray | None] = [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                out = predict(np.stack([x for _, x in waiting]))
                for (i, _), vec in zip(waiting, out):
                    if np.linalg.norm(vec) >= MIN_NORM:
                        vectors[i] = vec.astype(np.float32)
                waiting.clear()

            for i, picture in enumerate(_pictures(batch)):
                if picture is not None:
                    waiting.append((i, model_input(picture)))
                if len(waiting) == chunk:
                    flush()
            if waiting:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "vec"]
            )

    return source.mapInArrow(run, f"`{key}` string, vec array<float>")


def embed_features(vec: Column, in_dim: int, make_model: Callable[[], Predict], batch: int = 1024) -> Column:
    """Inference over feature rows as a column; the model is loaded once per Python worker."""
    run = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[in_dim]]
    )
    return run(vec)


def prepare_images(images: DataFrame, key: str, epoch: int | None = None) -> DataFrame:
    """``key, pixels`` (3 x 224 x 224 in [0, 1]); with ``epoch`` pictures are augmented first.

    The draw depends on (key, epoch) only.
    """
    source = images.select(
        F.col(key).cast("string").alias(key), "image", F.xxhash64(F.col(key), F.lit(epoch or 0)).alias("_seed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seeds = batch.column(key), batch.column("_seed").to_pylist()
            for i, picture in enumerate(_pictures(batch)):
                if picture is None:
                    continue
                pixels = model_input(picture if epoch is None else augment(picture, seeds[i]))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, 1), matrix_list(pixels.reshape(1, -1), pa.float32())], names=[key, "pixels"]
                )

    return source.mapInArrow(run, f"`{key}` string, pixels array<float>")


def project(rows: DataFrame, weights: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """Projection head: linear, ReLU, linear, unit length. Returns the ``keep`` columns and ``vec``.

    The weights (a few MB at most) travel with the task; rows stay where they are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = list_matrix(batch.column("feat"))
            out = np.maximum(x @ w["w1"].T + w["b1"], 0.0) @ w["w2"].T + w["b2"]
            lengths = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, matrix_list(out / lengths, pa.float64())], names=[*keep, "vec"])

    return rows.select(*keep, "feat").mapInArrow(run, schema)


def feature_dropout(vec: Column, row_id: Column, seed: int, rate: float = HEAD_DROPOUT) -> Column:
    """Zero a share of the positions and rescale the rest.

    The draw is a hash of (row, position, seed): it stays in the JVM and repeats on a retry.
    """
    draws = F.lit(1 << 20)

    def keep(x: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(row_id, i, F.lit(seed)), draws) / draws
        return F.when(draw >= rate, x.cast("double") / (1.0 - rate)).otherwise(F.lit(0.0))

    return F.transform(vec, keep)


def input_values() -> int:
    """Values of one prepared picture."""
    return 3 * INPUT_SIDE * INPUT_SIDE
