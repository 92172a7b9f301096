"""Token ids of a public byte-level BPE vocabulary, remembered per run of non-space characters."""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from vecbank.llm.batches import memory

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
REMEMBERED = 300_000
CUT = re.compile(r" (?=\S)")
LOOSE = re.compile(r" (?!\S)")


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, as little-endian 32-bit ids.

    The vocabulary's pattern always begins a new part before a space that stands before a non-space character, so
    the units between such cuts are encoded on their own. Units that were met before come from a bounded memory; new
    ones are encoded together by the same vocabulary's rank file, which is the faster of the two libraries.
    """

    def __init__(self, path: str, ranks_path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.sizes[rank] = len(word)
        self.known: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        """Encode new units in one go and cut the ids where the units end."""
        spaced = [" " + u for u in units]
        ids = np.array(self.bpe.encode_ordinary("".join(spaced)), "<u4")
        ends = np.cumsum([len(u.encode()) for u in spaced])
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right") * 4
        data = ids.tobytes()
        self.known.update(zip(units, map(data.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist())), strict=True))

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _first(self, unit: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(unit), "<u4").tobytes()

    def units(self, text: str) -> list[str]:
        """The text cut before each space that precedes a non-space; every unit but the first lost that space."""
        return CUT.split(text) if LOOSE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        cut = [None if any(s in t for s in self.special) else self.units(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = {u for units in cut if units for u in units[1:]} - known.keys()
        if new:
            self._learn(list(new))
        return [
            self._plain(text) if units is None else b"".join([self._first(units[0]), *map(known.__getitem__, units[1:])])
            for text, units in zip(texts, cut, strict=True)
        ]


def encoder(path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = path or public_tokenizers.path(BYTE_BPE), ranks_path or public_tokenizers.path(BYTE_RANKS)
    encoders = memory("encoders")
    if key not in encoders:
        encoders[key] = Encoder(*key)
    return encoders[key]
