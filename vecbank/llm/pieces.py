"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A normalised text (white space as U+2581, one in front) is cut before every run of markers; no piece crosses such a
cut, so the best segmentation of a text is that of its units. Tasks keep a bounded memory of units met before; new units
of a batch are segmented together: the trie is walked from all their characters at once, and the Viterbi recursion
goes through positions for all units in step. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, pieces as slices, record, text_bytes

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
UNIT = re.compile(r" ( *[^ ]*)")
REMEMBERED = 300_000
#: Longer units take the loop over their own characters, as stepping all units together would wait for them.
LONG_UNIT = 96
#: Places searched at once when the trie is built.
WINDOW = 1024
#: An unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces, their log scores, and the double-array trie: a child of node n by byte b is base[n] + b + 1 if check there is n."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    byte_of: np.ndarray
    base: np.ndarray
    check: np.ndarray
    piece_at: np.ndarray

    @property
    def unknown_score(self) -> float:
        return float(self.scores.min()) - UNKNOWN_PENALTY


def double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and piece of each node for (word, id); node 0 is the root, children are placed at the first free fit."""
    children: list[dict[int, int]] = [{}]
    piece = [-1]
    for word, number in words:
        node = 0
        for byte in word:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                piece.append(-1)
            node = children[node][byte]
        piece[node] = number
    size = 4 * len(children) + 4 * WINDOW
    base, check, piece_at = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    place, queue, free, front = {0: 0}, [0], 257, 0
    for node in queue:
        at = place[node]
        piece_at[at] = piece[node]
        symbols = np.array(sorted(children[node]), np.int64) + 1
        if not len(symbols):
            base[at] = size  # beyond every check: no child fits
            continue
        if len(symbols) == 1:  # any free place will do
            while taken[free]:
                free += 1
            start = free - int(symbols[0])
        else:
            start = front
            while True:
                clash = np.zeros(WINDOW, bool)
                for s in symbols:
                    clash |= taken[start + s : start + s + WINDOW]
                if not clash.all():
                    start += int(clash.argmin())
                    break
                start = front = start + WINDOW
        base[at] = start
        for s in symbols.tolist():
            taken[start + s], check[start + s], place[children[node][s - 1]] = True, at, start + s
            queue.append(children[node][s - 1])
    last = int(np.flatnonzero(taken).max()) + 1
    # A walk may look up to 256 places beyond the last node.
    base, check, piece_at = base[: last + 257], check[: last + 257], piece_at[: last + 257]
    base[base >= last] = last
    return base, check, piece_at


def vocabulary(path: str | None = None) -> Vocabulary:
    """Read a SentencePiece model; its pieces' scores are the log scores. Control pieces never match text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    n = model.get_piece_size()
    names, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)], np.float64)
    byte_ids, byte_of = np.full(256, -1, np.int32), np.full(n, -1, np.int32)
    words, pieces = [], []
    for i, name in enumerate(names):
        if model.is_byte(i):
            value = int(name[3:5], 16)
            byte_ids[value], byte_of[i] = i, value
            pieces.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(name.encode())
            words.append((name.encode(), i))
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    used = np.array([i for _, i in words])
    scores[np.setdiff1d(np.arange(n), used)] = scores[used].min()
    return Vocabulary(pieces, scores, byte_ids, byte_of, *double_array(words))


def matches(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces that begin at ``starts`` and end by ``ends``: (index of the start, length, piece)."""
    index, node, at = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = 0
    while len(index):
        to = vocab.base[node] + data[at].astype(np.int64) + 1
        ok = vocab.check[to] == node
        index, node, at = index[ok], to[ok], at[ok] + 1
        length += 1
        piece = vocab.piece_at[node]
        hit = piece >= 0
        found.append((index[hit], np.full(int(hit.sum()), length), piece[hit]))
        more = at < ends[index]
        index, node, at = index[more], node[more], at[more]
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def segment(vocab: Vocabulary, units: list[bytes]) -> list[bytes]:
    """Best segmentation of each unit as little-endian 32-bit ids; of equal ones that whose pieces reach back furthest."""
    sizes = np.array([len(u) for u in units], np.int64)
    data = np.frombuffer(b"".join(units) + b"\0", np.uint8)
    first = np.r_[0, np.cumsum(sizes)]
    is_start = (data[:-1] & 0xC0) != 0x80
    is_start[first[:-1][sizes > 0]] = True
    starts = np.flatnonzero(is_start)
    owner = np.searchsorted(first, starts, side="right") - 1
    width = np.diff(np.r_[starts, len(data) - 1])
    index, length, piece = matches(vocab, data, starts, first[owner + 1])
    # A piece must end where a character ends; a character without a piece of its own is unknown.
    whole = np.r_[is_start, True][starts[index] + length] | (starts[index] + length == first[owner[index] + 1])
    index, length, piece = index[whole], length[whole], piece[whole]
    known = np.zeros(len(starts), bool)
    known[index[length == width[index]]] = True
    lost = np.flatnonzero(~known)
    index, length = np.r_[index, lost], np.r_[length, width[lost]]
    piece = np.r_[piece, np.full(len(lost), -1)]
    score = np.where(piece >= 0, vocab.scores[piece], vocab.unknown_score)
    # States are the byte positions 0..size of each unit.
    base = first[:-1] + np.arange(len(units))
    best = np.full(int(first[-1]) + len(units), -np.inf)
    best[base] = 0.0
    back, by = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
    local = starts[index] - first[owner[index]]
    frm, to = base[owner[index]] + local, base[owner[index]] + local + length
    order = np.lexsort((local, sizes[owner[index]] > LONG_UNIT))
    frm, to, score, piece, local = frm[order], to[order], score[order], piece[order], local[order]
    short = int((sizes[owner[index]] <= LONG_UNIT).sum())
    cuts = np.r_[0, np.flatnonzero(np.diff(local[:short])) + 1, short] if short else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        reached = best[frm[a:b]] + score[a:b]
        better = np.flatnonzero(reached > best[to[a:b]]) + a
        best[to[better]], back[to[better]], by[to[better]] = reached[better - a], frm[better], piece[better]
    if short < len(frm):
        long_order = np.argsort(frm[short:], kind="stable") + short
        reach: dict[int, float] = {int(b): 0.0 for b in base[sizes > LONG_UNIT]}
        for f, t, s, p in zip(frm[long_order].tolist(), to[long_order].tolist(), score[long_order].tolist(), piece[long_order].tolist(), strict=True):
            value = reach[f] + s
            if value > reach.get(t, -np.inf):
                reach[t] = value
                back[t], by[t] = f, p
    return traced(vocab, data, first, base, back, by)


def traced(vocab: Vocabulary, data: np.ndarray, first: np.ndarray, base: np.ndarray, back: np.ndarray, by: np.ndarray) -> list[bytes]:
    """Follow the best pieces back from the end of every unit and spell unknown characters in byte pieces."""
    n = len(base)
    at, unit = base + np.diff(first), np.arange(n)
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        open_ = at > base[unit]
        at, unit = at[open_], unit[open_]
        if not len(at):
            break
        rounds.append((unit, at, by[at]))
        at = back[at]
    if not rounds:
        return [b""] * n
    unit, end, ids = (np.concatenate(x) for x in zip(*rounds, strict=True))
    order = np.lexsort((end, unit))
    unit, end, ids = unit[order], end[order], ids[order]
    lost = ids < 0
    if lost.any():
        begin = np.where(np.r_[True, unit[1:] != unit[:-1]], base[unit], np.r_[0, end[:-1]])
        times = np.where(lost, end - begin, 1)
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        place = np.repeat(begin - unit, times) + nth  # states to bytes: one state more per unit
        ids = np.where(np.repeat(lost, times), vocab.byte_ids[data[np.minimum(place, len(data) - 1)]], np.repeat(ids, times))
        unit = np.repeat(unit, times)
    raw = ids.astype("<u4").tobytes()
    cuts = (4 * np.searchsorted(unit, np.arange(n + 1))).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; the empty text has none."""
        cut = [self.units(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({u for units in cut for u in units} - self.known.keys())
        if new:
            self.known.update(zip(new, segment(self.vocab, [MARK + u.replace(" ", "▁").encode("utf-8", "replace") for u in new]), strict=True))
        return [b"".join(map(self.known.__getitem__, units)) for units in cut]

    @staticmethod
    def units(text: str) -> list[str]:
        """Cut the text, with its leading marker, before every run of spaces; the first space of a unit is left out."""
        if "▁" in text:
            text = text.replace("▁", " ")
        return text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else UNIT.findall(" " + text)


def decoded(vocab: Vocabulary, ids: bytes) -> str:
    """The text of a sequence of ids: pieces and bytes joined, markers as spaces, without the leading one."""
    table = vocab.pieces
    text = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).replace(MARK, b" ")
    return text.removeprefix(b" ").decode("utf-8", "replace")


def shared(spark: SparkSession, path: str | None = None):
    """The vocabulary as a broadcast: a fixed file, a few megabytes."""
    return spark.sparkContext.broadcast(vocabulary(path))


_encoders: dict[int, Encoder] = {}


def encoder(broadcast) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    vocab = broadcast.value
    if id(vocab) not in _encoders:
        _encoders.clear()
        _encoders[id(vocab)] = Encoder(vocab)
    return _encoders[id(vocab)]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int): one row per row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no ids. A literal U+2581 counts as a space. Further columns are not looked at; null ids and
    repeated rows are carried along. An empty table gives an empty result.
    """
    vocab = shared(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab)
        for batch in slices(batches, "text"):
            doc_ids, texts = columns(batch, "doc_id", "text")
            found = own.encode([t.decode("utf-8", "replace") for t in texts])
            yield record(schema, {"doc_id": doc_ids, "ids": [np.frombuffer(f, "<u4").astype(np.int32) for f in found]})

    return docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text, ids outside the vocabulary or null are left out."""
    vocab = shared(rows.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.value
        n = len(own.pieces)
        for batch in batches:
            doc_ids, ids = columns(batch, "doc_id", "ids")
            kept = [np.array([i for i in x or () if i is not None and 0 <= i < n], "<u4").tobytes() for x in ids]
            yield record(schema, {"doc_id": doc_ids, "text": [decoded(own, x) for x in kept]})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encoding and decoding of every text in one pass: ``doc_id, n_ids, n_byte_ids, ids_crc32, decoded_chars, round_trip``.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids; ``round_trip`` tells whether the decoded text equals the text with
    U+2581 as space.
    """
    vocab = shared(docs.sparkSession, path)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("ids_crc32", pa.int64()),
        ("decoded_chars", pa.int64()), ("round_trip", pa.bool_()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab)
        is_byte = own.vocab.byte_of >= 0
        for batch in slices(batches, "text"):
            doc_ids, raw = columns(batch, "doc_id", "text")
            texts = [t.decode("utf-8", "replace") for t in raw]
            found = own.encode(texts)
            back = [decoded(own.vocab, f) for f in found]
            yield record(schema, {
                "doc_id": doc_ids, "n_ids": [len(f) // 4 for f in found],
                "n_byte_ids": [int(is_byte[np.frombuffer(f, "<u4")].sum()) for f in found],
                "ids_crc32": [zlib.crc32(f) for f in found], "decoded_chars": [len(b) for b in back],
                "round_trip": [b == t.replace("▁", " ") for b, t in zip(back, texts, strict=True)],
            })

    return docs.select("doc_id", text_bytes()).mapInArrow(
        run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_chars long, round_trip boolean"
    )
