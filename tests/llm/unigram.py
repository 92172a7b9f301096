"""A unigram twin of a SentencePiece model, for comparison: the same pieces and scores, another model type."""

import sentencepiece


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def fields(data: bytes):
    """(number, wire type, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, 0, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, key & 7, data[at : at + size]
            at += size


def message(parts) -> bytes:
    out = b""
    for field, wire, value in parts:
        out += varint(field << 3 | wire)
        out += varint(value) if wire == 0 else (varint(len(value)) if wire == 2 else b"") + value
    return out


def unigram(path: str) -> sentencepiece.SentencePieceProcessor:
    with open(path, "rb") as file:
        parts = list(fields(file.read()))
    turned = []
    for field, wire, value in parts:
        if field == 2:  # trainer_spec: model_type is field 3, unigram is 1
            value = message((f, w, 1 if f == 3 else v) for f, w, v in fields(value))
        turned.append((field, wire, value))
    return sentencepiece.SentencePieceProcessor(model_proto=message(turned))
