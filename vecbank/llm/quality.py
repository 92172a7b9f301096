"""Quality classifier: a byte-level convolutional network in NumPy.

A document's bytes are embedded and met by learned filters (``WIDTH`` bytes wide, one step apart). The text is covered
by chunks that overlap by ``WIDTH - 1`` bytes, so every window of bytes lies in one chunk. Each filter keeps its maximum
per chunk; the largest, the mean and the smallest maximum over the chunks of a document go into one logistic unit (the
smallest shows stretches with little variety; a shorter last chunk counts for it only if it is the only one).

Training happens on the driver, on a sample bounded by ``SAMPLE_DOCS`` documents of each class and ``SAMPLE_BYTES`` in
all; training and scoring both pool over every byte of a text. Scoring runs in tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecbank.llm.batches import memory, pieces, text_bytes
from vecbank.session import materialize

CHUNK = 256
WIDTH = 5
FILTERS = 16
EMBEDDING = 8
#: Training rows of each class at most, and bytes of all their texts.
SAMPLE_DOCS = 1200
SAMPLE_BYTES = 1 << 24
EPOCHS = 12
BATCH_DOCS = 64
BLOCK = 1 << 14
#: Rows of chunks that training answers at once.
ROWS = 512


class Network:
    """Weights: byte embedding (256 x E), filters (WIDTH x E x F), their biases, and the logistic unit (3F + 1)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = rng.normal(0, (2 / (WIDTH * EMBEDDING)) ** 0.5, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 3 * FILTERS + 1).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out]

    def responses(self, data: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Filter responses at every position of ``data`` that has ``WIDTH`` bytes."""
        n = len(data) - WIDTH + 1
        total = tables[0].take(data[:n], axis=0)
        for j in range(1, WIDTH):
            total += tables[j].take(data[j : j + n], axis=0)
        return total

    def tables(self) -> np.ndarray:
        """Response of each filter to each byte in each place: embedding and filters in one."""
        tables = np.einsum("be,jef->jbf", self.embedding, self.filters)
        tables[0] += self.bias
        return np.ascontiguousarray(tables, np.float32)


def chunk_starts(length: int) -> np.ndarray:
    """Starts of the chunks of a text of ``length`` bytes; each holds the windows that start in its CHUNK positions."""
    return np.arange(0, max(length - WIDTH + 1, 1), CHUNK)


def padded(content: bytes) -> bytes:
    """Texts shorter than a filter are filled up with zero bytes."""
    return content.ljust(WIDTH, b"\0")


def scores(network: Network, contents: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
    """One probability per text; each text is read whole, in blocks of bounded size."""
    tables = network.tables() if tables is None else tables
    features = np.empty((len(contents), 3 * FILTERS), np.float32)
    for i, content in enumerate(contents):
        data = np.frombuffer(padded(content), np.uint8)
        maxima = []
        windows = len(data) - WIDTH + 1
        for at in range(0, windows, BLOCK):
            found = network.responses(data[at : min(at + BLOCK, windows) + WIDTH - 1], tables)
            maxima.append(np.maximum.reduceat(found, np.arange(0, len(found), CHUNK), axis=0))
        pooled = np.maximum(np.concatenate(maxima), 0)
        whole = pooled[: max(windows // CHUNK, 1)]
        features[i] = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0), whole.min(axis=0)])
    return probability(features @ network.out[:-1] + network.out[-1])


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def first_of(mask: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the marks of each document in each column only the first."""
    order = np.cumsum(mask, axis=0)
    before = np.repeat(order[first] - mask[first], size, axis=0)
    return mask & (order - before == 1)


def gradients(network: Network, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray,
              whole: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the weighted log loss and the loss. ``chunks``: rows of CHUNK + WIDTH - 1 bytes, those of one document
    together; ``owner``: their document; ``whole``: chunks that count for the smallest maximum."""
    docs, n = len(labels), CHUNK
    tables, stride = network.tables(), chunks.shape[1]
    at, pooled = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), np.float32)
    for s in range(0, len(chunks), ROWS):
        block = chunks[s : s + ROWS]
        flat = network.responses(block.reshape(-1), tables)
        # Positions whose window runs over the end of a row are left out of the maximum.
        flat = np.concatenate([flat, np.full((WIDTH - 1, FILTERS), -np.inf, np.float32)]).reshape(len(block), stride, FILTERS)[:, :n]
        at[s : s + ROWS] = flat.argmax(axis=1)
        pooled[s : s + ROWS] = np.maximum(np.take_along_axis(flat, at[s : s + ROWS, None], axis=1)[:, 0], 0)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, len(owner)])
    top, mean = np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / size[:, None]
    held = np.where(whole[:, None], pooled, np.inf)
    least = np.minimum.reduceat(held, first)
    features = np.concatenate([top, mean, least], axis=1)
    p = probability(features @ network.out[:-1] + network.out[-1])
    loss = float(-(weight * np.where(labels, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum() / docs)
    error = (weight * (p - labels) / docs).astype(np.float32)
    d_out = np.r_[features.T @ error, error.sum()].astype(np.float32)
    d_top, d_mean, d_least = (np.outer(error, w) for w in np.split(network.out[:-1], 3))
    # Of equal chunks the first takes the gradient of a document's largest or smallest maximum.
    d_pool = np.repeat(d_mean / size[:, None], size, axis=0)
    d_pool += first_of(pooled == np.repeat(top, size, axis=0), first, size) * np.repeat(d_top, size, axis=0)
    d_pool += first_of(held == np.repeat(least, size, axis=0), first, size) * np.repeat(d_least, size, axis=0)
    d_pool *= pooled > 0
    d_filters, d_embedding = np.zeros_like(network.filters), np.zeros_like(network.embedding)
    rows = np.arange(len(chunks))[:, None]
    for j in range(WIDTH):
        byte = chunks[rows, at + j]
        by_byte = np.zeros((256, FILTERS), np.float32)
        for f in range(FILTERS):
            by_byte[:, f] = np.bincount(byte[:, f], weights=d_pool[:, f], minlength=256)
        d_filters[j] = network.embedding.T @ by_byte
        d_embedding += by_byte @ network.filters[j].T
    return [d_embedding, d_filters, d_pool.sum(axis=0), d_out], loss


def train(texts: list[list[bytes]], labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS, rate: float = 0.01) -> Network:
    """Adam on documents given as lists of chunks (bytes); the classes weigh the same."""
    network, rng = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    by_class = 0.5 / np.maximum(share, 1e-9)
    rows = [np.stack([np.frombuffer(c.ljust(CHUNK + WIDTH - 1, b"\0"), np.uint8) for c in chunks]) for chunks in texts]
    whole = [np.array([len(c) == CHUNK + WIDTH - 1 for c in chunks]) for chunks in texts]
    for mark in whole:
        mark[0] |= not mark.any()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    step = 0
    total = epochs * -(-len(rows) // BATCH_DOCS)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH_DOCS):
            docs = order[at : at + BATCH_DOCS]
            owner = np.repeat(np.arange(len(docs)), [len(rows[d]) for d in docs])
            found, _ = gradients(network, np.concatenate([rows[d] for d in docs]), owner, labels[docs], by_class[labels[docs]], np.concatenate([whole[d] for d in docs]))
            step += 1
            pace = rate * (1 - step / (total + 1))
            for w, g, (m, v) in zip(network.weights(), found, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network


def chunked(content: bytes) -> list[bytes]:
    """All chunks of a text."""
    content = padded(content)
    return [content[s : s + CHUNK + WIDTH - 1] for s in chunk_starts(len(content)).tolist()]


def within(lengths: list[tuple[int, int]], most: int) -> list[int]:
    """Of (id, bytes) in this order those whose sum stays within ``most``; what does not fit any more is passed over."""
    chosen, total = [], 0
    for doc_id, size in lengths:
        if total + size <= most:
            chosen.append(doc_id)
            total += size
    return chosen


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_DOCS, seed: int = 0, most: int = SAMPLE_BYTES) -> Network:
    """A network trained on up to ``sample`` labelled documents of each class that are not held out, whole texts of ``most``
    bytes in all.

    The sample is drawn by a hash of the id; a text that does not fit into what is left of ``most`` is passed over. Labels
    other than 0 and 1, null ids, null labels and ids with both labels are left out; of rows that repeat an id the smallest
    text is read. Without any labelled row the network keeps its initial weights.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("__label"), F.max(label).alias("__most"))
    usable = usable.filter("__label = __most").select("doc_id", "__label")
    chosen = [usable.filter(F.col("__label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x sample rows of two numbers
    rows = docs.select("doc_id", text_bytes()).join(wanted, "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    rows = materialize(rows, "labelled")  # at most 2 x sample texts
    lengths = rows.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    ids = within([(r["doc_id"], r["size"]) for r in lengths], most)
    found = sorted(rows.filter(F.col("doc_id").isin(ids)).collect(), key=lambda r: r["doc_id"]) if ids else []
    if not found:
        return Network(seed)
    return train([chunked(bytes(r["text"])) for r in found], np.array([r["__label"] for r in found]), seed)


def score(docs: DataFrame, network: Network, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """``docs`` with the probability of label 1 and the prediction (1 from 0.5 on) appended; own columns of these names are replaced.

    A null or empty text is scored as zero bytes. Rows are judged one by one, so repeated rows get equal scores; further
    columns are carried along. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in (score_name, predicted_name)]
    schema = T.StructType([*docs.select(*kept).schema, T.StructField(score_name, T.DoubleType()), T.StructField(predicted_name, T.IntegerType())])
    # A text that is carried along is read from its own column, so that it travels once.
    own_text = "text" in kept and isinstance(docs.schema["text"].dataType, T.StringType)
    name = "text" if own_text else "__text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("classifier")  # weights come with their task
        tables = network.tables()
        for batch in pieces(batches, name):
            contents = batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).fill_null(b"")
            found = scores(network, contents.to_pylist(), tables)
            own = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*kept, score_name, predicted_name])

    return docs.select(*kept, *([] if own_text else [text_bytes().alias(name)])).mapInArrow(run, schema)
