"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every place of a text contributes six triplets: its byte with two of the four bytes before it. Triplets are hashed into 256
buckets; a bucket is coded by the quartile of all bucket counts that it falls into (two bits), and the length of the text by
its leading bits. The difference of two digests adds the steps between quartiles and a bounded weight for the lengths, so
small edits move few buckets by one step, and texts of any size compare by 65 bytes. All figures are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, flushed, pieces as slices, text_bytes
from vecbank.session import materialize

BUCKETS = 256
#: Distances back to the other two bytes of the triplets at a place.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
REACH = 4
MULTIPLIER = 2654435761
LENGTH_WEIGHT, LENGTH_STEPS = 8, 32
#: Differences from here on count as no likeness at all; unrelated texts lie around it.
FAR = 384
WINDOW_BYTES = 1 << 20
DIGEST_BYTES = BUCKETS // 4 + 1


def triplet_counts(texts: list[bytes]) -> np.ndarray:
    """Bucket counts of each text, a row per text; long texts are read in windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(sizes) - sizes
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for start in range(0, len(data), WINDOW_BYTES):
        end, low = min(start + WINDOW_BYTES, len(data)), max(start - REACH, 0)
        window = data[low:end].astype(np.uint64)
        place = np.arange(start, end)
        owner = np.searchsorted(first, place, side="right") - 1
        inside, row = place - first[owner], owner * BUCKETS
        for salt, (near, far) in enumerate(TRIPLETS):
            at = np.flatnonzero(inside >= far) + start - low
            value = np.uint64(salt << 24) | window[at] << np.uint64(16) | window[at - near] << np.uint64(8) | window[at - far]
            bucket = (value * np.uint64(MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(24)
            counts += np.bincount(row[at - (start - low)] + bucket.astype(np.int64), minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def length_code(size: int) -> int:
    """The length's leading four bits and its number of bits, in one byte: eight steps for every doubling."""
    if size < 8:
        return size
    bits = size.bit_length()
    return min(8 * (bits - 3) + (size >> (bits - 4) & 7), 255)


def digests(texts: list[bytes]) -> np.ndarray:
    """A row per text: length code, then the buckets' quartiles, four to a byte."""
    counts = triplet_counts(texts)
    limits = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > limits[:, None, :]).sum(axis=2).astype(np.uint8).reshape(len(texts), BUCKETS // 4, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    return np.concatenate([np.array([length_code(len(t)) for t in texts], np.uint8).reshape(-1, 1), packed], axis=1)


def steps() -> np.ndarray:
    """Sum of the quartile steps between any two bytes of four codes each."""
    codes = np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3
    return np.abs(codes[:, None, :] - codes[None, :, :]).sum(axis=2)


STEPS = steps()


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling with their difference to 0; row by row."""
    lengths = np.minimum(np.abs(one[:, 0].astype(np.int64) - other[:, 0]), LENGTH_STEPS)
    difference = STEPS[one[:, 1:], other[:, 1:]].sum(axis=1) + LENGTH_WEIGHT * lengths
    return (FAR - np.minimum(difference, FAR)) / FAR


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following text, or all of that."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
PASSED = pa.schema([*ROW, ("part", pa.int32()), ("edge", pa.int32()), ("body", pa.binary())])
ROW_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows at the ends of a range are handed on with their texts.
DONE, FIRST, LAST = 0, 1, 2


def compared(doc_ids: list, bodies: list[bytes], own: np.ndarray, following: np.ndarray, next_bodies: list[bytes]) -> Iterator[tuple]:
    """Result rows for documents, their digests, and what follows each of them."""
    texts, nexts = ([b.decode("utf-8", "replace") for b in side] for side in (bodies, next_bodies))
    changed = [edited(t, n).encode() for t, n in zip(texts, nexts, strict=True)]
    theirs = digests(changed)
    near, beside = likeness(own, theirs), likeness(own, following)
    for i, doc_id in enumerate(doc_ids):
        yield (doc_id, len(texts[i]), hashlib.sha256(changed[i]).hexdigest(), own[i].tobytes().hex(), theirs[i].tobytes().hex(),
               float(near[i]), float(beside[i]))


def along(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of one range in order: all but the last meet their successor; the first and the last are handed on."""
    part, held = TaskContext.get().partitionId(), None
    blank = (None,) * len(ROW)
    for batch in slices(batches, "text"):
        doc_ids, bodies = columns(batch, "doc_id", "text")
        own = digests(bodies)
        if held is None:
            yield (*blank, part, FIRST, bodies[0])
        else:
            doc_ids, bodies, own = [held[0], *doc_ids], [held[1], *bodies], np.concatenate([held[2], own])
        for row in compared(doc_ids[:-1], bodies[:-1], own[:-1], own[1:], bodies[1:]):
            yield (*row, part, DONE, None)
        held = doc_ids[-1], bodies[-1], own[-1:]
    if held is not None:
        yield (held[0], *blank[1:], part, LAST, held[1])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.

    The next document is the one with the next larger doc_id; after the last comes the first, a single row follows itself.
    Rows without id come first; rows that share an id follow each other in the order of a hash of their texts, equal ones are each
    other's next. A null text counts as empty; texts of fewer than three bytes have no triplets and differ by length only. An
    empty table gives an empty result, further columns are not looked at.

    Documents are sorted into ranges once; a task reads its range with one document of memory. The last row of a range meets the
    first of the next in a join over two rows per range.
    """
    keyed = docs.select("doc_id", text_bytes()).withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    order = ["doc_id", "h", "m"]
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed(along(batches), PASSED, lambda row: 500 + len(row[-1] or b""))

    passed = materialize(ranges.mapInArrow(walk, f"{ROW_DDL}, part int, edge int, body binary"), "fingerprints")
    firsts = passed.filter(F.col("edge") == FIRST).select(F.col("part").alias("next_part"), F.col("body").alias("next_body"))
    # A row per range: small whatever the table's size; ranges without rows are not among them.
    parts = passed.filter(F.col("edge") == FIRST).select("part")
    following = parts.withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    following = following.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    ends = passed.filter(F.col("edge") == LAST).select("doc_id", "body", "part").join(following, "part").join(firsts, "next_part")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches, "body"):
                doc_ids, bodies, nexts = columns(batch, "doc_id", "body", "next_body")
                yield from compared(doc_ids, bodies, digests(bodies), digests(nexts), nexts)

        yield from flushed(rows(), ROW, lambda row: 500)

    closed = ends.select("doc_id", "body", "next_body").mapInArrow(close, ROW_DDL)
    return passed.filter(F.col("edge") == DONE).select(*ROW.names).unionByName(closed)


FINGERPRINT_SQL = f"""
    with d as (
      select doc_id, coalesce(text, '') as text, coalesce(lead(text) over (order by doc_id), '') as following,
             row_number() over (order by doc_id desc) = 1 as is_last, first_value(text) over (order by doc_id) as head
      from documents),
    t as (
      select doc_id, text, length(text) as n, case when is_last then coalesce(head, '') else following end as nxt from d),
    e as (
      select doc_id, n, 0 as kind, text from t
      union all select doc_id, n, 1, left(text, n - n // 4) || left(nxt, n // 4) from t),
    b as (select doc_id, n, kind, text, hex(encode(text)) as bytes from e),
    codes as (select doc_id, kind, len(bytes) // 2 as size from b),
    chunks as (
      select doc_id, kind, k, substr(bytes, 256 * k + 1, 256) as part
      from (select doc_id, kind, bytes, unnest(range(0, (len(bytes) + 255) // 256)) as k from b)),
    bytes as (
      select doc_id, kind, 128 * k + i as i,
             instr('123456789ABCDEF', substr(part, 2 * i + 1, 1)) * 16 + instr('123456789ABCDEF', substr(part, 2 * i + 2, 1)) as v
      from (select doc_id, kind, k, part, unnest(range(0, len(part) // 2)) as i from chunks)),
    places as materialized (
      select doc_id, kind, i, v, lag(v, 1) over w as b1, lag(v, 2) over w as b2, lag(v, 3) over w as b3, lag(v, 4) over w as b4
      from bytes window w as (partition by doc_id, kind order by i)),
    triplets as (
      {" union all ".join(f"select doc_id, kind, (({s} * 16777216 + v * 65536 + b{p} * 256 + b{r}) * {MULTIPLIER} % 4294967296) // 16777216 as bucket from places where i >= {r}" for s, (p, r) in enumerate(TRIPLETS))}),
    counted as (select doc_id, kind, bucket, count(*) as c from triplets group by all),
    filled as materialized (
      select g.doc_id, g.kind, g.bucket, coalesce(c, 0) as c
      from (select doc_id, kind, unnest(range({BUCKETS})) as bucket from codes) g left join counted using (doc_id, kind, bucket)),
    limits as (
      select doc_id, kind, s[{BUCKETS // 4}] as s1, s[{BUCKETS // 2}] as s2, s[{3 * BUCKETS // 4}] as s3
      from (select doc_id, kind, list_sort(list(c)) as s from filled group by all)),
    quartiles as (
      select doc_id, kind, list((c > s1)::int + (c > s2)::int + (c > s3)::int order by bucket) as q
      from filled join limits using (doc_id, kind) group by all),
    coded as (
      select doc_id, kind, q, case when size < 8 then size
               else 8 * (length(bin(size)) - 3) + ((size >> (length(bin(size)) - 4)) & 7) end as l
      from quartiles join codes using (doc_id, kind)),
    printed as (
      select doc_id, kind, q, l, lower(printf('%02x', l::int) || array_to_string(list_transform(range(0, {BUCKETS // 4}),
               lambda i: printf('%02x', (q[4 * i + 1] * 64 + q[4 * i + 2] * 16 + q[4 * i + 3] * 4 + q[4 * i + 4])::int)), '')) as f
      from coded),
    own as (select *, row_number() over (order by doc_id) as nth, count(*) over () as total from printed where kind = 0),
    pairs as (
      select o.doc_id, o.f, e.f as ef,
             least({FAR}, list_sum(list_transform(o.q, lambda x, i: abs(x - e.q[i]))) + {LENGTH_WEIGHT} * least({LENGTH_STEPS}, abs(o.l - e.l))) as de,
             least({FAR}, list_sum(list_transform(o.q, lambda x, i: abs(x - x2.q[i]))) + {LENGTH_WEIGHT} * least({LENGTH_STEPS}, abs(o.l - x2.l))) as dn
      from own o join printed e on e.doc_id = o.doc_id and e.kind = 1 join own x2 on x2.nth = o.nth % o.total + 1)
    select doc_id, n as n_chars, sha256(text) as edited_sha256, f as fingerprint, ef as edited_fingerprint,
           ({FAR} - de)::double / {FAR} as near_edited, ({FAR} - dn)::double / {FAR} as near_next
    from pairs join b using (doc_id) where b.kind = 1"""
