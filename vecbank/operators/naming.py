"""Label dictionaries, name resolution and suggestions."""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecbank.functions.names import name_key, new_name
from vecbank.operators.blocks import blocked_join
from vecbank.operators.ordered import numbered
from vecbank.settings import SUGGESTION_COUNT, SUGGESTION_CUTOFF

#: Tokens in a key, keys of a name for one length of the other, and tokens whose frequency is looked up.
KEY_TOKENS, KEYS_PER_LENGTH, COMMON_TOKENS = 4, 60, 4096


def name_index(bank: DataFrame) -> DataFrame:
    """``key, species``: where two names share a key, the one first seen in the bank counts."""
    first = bank.groupBy("species").agg(F.min("row_id").alias("row_id"))
    return (
        first.withColumn("key", name_key(F.col("species")))
        .filter(F.length("key") > 0)
        .groupBy("key")
        .agg(F.min_by("species", "row_id").alias("species"))
    )


def resolve_names(requests: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """Add ``species`` (null when unknown). One row per key on the right; Spark broadcasts it if small."""
    keyed = requests.withColumn("key", name_key(F.col(name)))
    return keyed.join(index, "key", "left")


def label_universe(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Sorted distinct names of both sources: ``species, is_local, idx`` (idx from 0)."""
    both = local.select("species", F.lit(True).alias("is_local")).unionByName(
        remote.select("species", F.lit(False).alias("is_local"))
    )
    names = both.filter(F.length("species") > 0).groupBy("species").agg(F.max("is_local").alias("is_local"))
    return numbered(names, ["species"], name="_n").withColumn("idx", F.col("_n") - 1).drop("_n")


def cap_labels(universe: DataFrame, max_labels: int = 0) -> DataFrame:
    """At most ``max_labels`` names, local ones first; 0 keeps all. ``idx`` is the place in that list.

    Below the cap the plain sorted order is kept. A top-n sort, so no task sees all names.
    """
    total = universe.count()
    if max_labels <= 0 or total <= max_labels:
        return universe
    chosen = universe.drop("idx").orderBy(F.desc("is_local"), "species").limit(max_labels)
    # max_labels rows: small by definition of the cap.
    place = Window.orderBy(F.desc("is_local"), "species")
    return chosen.withColumn("idx", (F.row_number().over(place) - 1).cast("long"))


def remote_only(local: DataFrame, remote: DataFrame) -> DataFrame:
    return remote.select("species").subtract(local.select("species"))


def decode_labels(rows: DataFrame, dictionary: DataFrame, code: str, unknown: str = "unknown") -> DataFrame:
    """Label code -> name; a code without entry is ``unknown``. dictionary: ``idx, species``."""
    names = dictionary.select(F.col("idx").alias(code), F.col("species").alias("_name"))
    return rows.join(names, code, "left").withColumn("species", F.coalesce("_name", F.lit(unknown))).drop("_name")


def encode_labels(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Known labels only, with their index."""
    return rows.join(dictionary.select("species", "idx"), "species")


def known_only(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    return rows.join(dictionary.select("species"), "species", "left_semi")


def _char_counts(words: list[str], alphabet: dict[str, int]) -> np.ndarray:
    counts = np.zeros((len(words), len(alphabet)), dtype=np.int16)
    for i, word in enumerate(words):
        for ch in word:
            counts[i, alphabet[ch]] += 1
    return counts


def close_names(
    words: list[str], labels: list[str], n: int, cutoff: float, chosen: Callable[[str, str], bool] = lambda word, label: True
) -> list[tuple[str, str, float]]:
    """(word, label, ratio) of the n closest labels per word, ratio >= cutoff, among the pairs that are ``chosen``.

    The shared characters bound the ratio from above, so most pairs never reach the matcher.
    """
    out = []
    matcher = difflib.SequenceMatcher()
    for word, within in sharing_enough(words, labels, cutoff):
        matcher.set_seq2(word)
        scored = []
        for label in within:
            if chosen(word, label):
                matcher.set_seq1(label)
                ratio = matcher.ratio()
                if ratio >= cutoff:
                    scored.append((ratio, label))
        scored.sort(reverse=True)
        out.extend((word, label, ratio) for ratio, label in scored[:n])
    return out


def sharing_enough(words: list[str], labels: list[str], cutoff: float) -> Iterator[tuple[str, list[str]]]:
    """Per word, the labels that share enough characters, each counted as often as both hold it, for the cutoff."""
    alphabet = {ch: i for i, ch in enumerate(sorted(set("".join(words) + "".join(labels))))}
    label_counts = _char_counts(labels, alphabet)
    label_lengths = np.array([len(x) for x in labels])
    for word, counts in zip(words, _char_counts(words, alphabet)):
        total = label_lengths + len(word)
        ceiling = 2.0 * np.minimum(label_counts, counts).sum(axis=1) / np.maximum(total, 1)
        yield word, [labels[i] for i in np.flatnonzero(ceiling >= cutoff - 1e-12)]


class CharacterIndex:
    """Keys by which names meet that share enough characters for a ratio of ``cutoff``.

    A name is the set of its (character, occurrence) pairs. Two names of lengths a and b reach the cutoff only if they share
    at least t = cutoff (a + b) / 2 of them. Put in one order, the rarest first, the k smallest of the shared ones then lie
    among the first a - t + k of the one and the first b - t + k of the other, so names meet under (a, b, these k); k is the
    largest that keeps the keys of a name few. The ratio of matching blocks allows for names without a common pair of
    neighbouring characters, so longer grams would lose some.
    """

    def __init__(self, common: dict[str, int], cutoff: float):
        self.common, self.cutoff = common, cutoff

    def tokens(self, name: str) -> list[str]:
        """(character, occurrence) pairs in order: those not known as common first, then the less common ones."""
        seen: dict[str, int] = {}
        out = []
        for ch in name:
            seen[ch] = seen.get(ch, 0) + 1
            out.append(f"{ch}{seen[ch]} ")
        return sorted(out, key=lambda x: (self.common.get(x, 0), x))

    def depth(self, a: int, b: int) -> tuple[int, int]:
        """(t, k) of two lengths."""
        least, k = math.ceil(self.cutoff * (a + b) / 2 - 1e-9), 1
        for more in range(2, min(least, KEY_TOKENS) + 1):
            if math.comb(max(a, b) - least + more, more) <= KEYS_PER_LENGTH:
                k = more
        return max(least, 1), k

    def lengths(self, length: int, others: list[int]) -> list[int]:
        return [o for o in others if self.depth(length, o)[0] <= min(length, o)]

    def keys(self, name: str, others: list[int], is_word: bool) -> Iterator[str]:
        tokens = self.tokens(name)
        for other in self.lengths(len(name), others):
            least, k = self.depth(len(name), other)
            a, b = (len(name), other) if is_word else (other, len(name))
            for some in itertools.combinations(tokens[: len(name) - least + k], k):
                yield f"{a}|{b}|{''.join(some)}"

    def meets_here(self, key: str, word: str, label: str) -> bool:
        """Whether ``key`` is the first that both have, so that a pair is looked at once."""
        _, k = self.depth(len(word), len(label))
        own = set(self.tokens(label))
        first = itertools.islice((t for t in self.tokens(word) if t in own), k)
        return key.split("|", 2)[2] == "".join(first)


def _indexed(
    words: DataFrame, labels: DataFrame, cutoff: float, kernel: Callable[[CharacterIndex, str, list[str], list[str]], pa.RecordBatch | None],
    schema: str, block_rows: int,
) -> DataFrame:
    """Let ``words`` (``word``) and ``labels`` (``label``) meet under their shared keys, in bounded blocks."""
    spark = words.sparkSession
    # Lengths are few; the commonest characters are a bounded list, any order of tokens gives the same pairs.
    lengths = [sorted(r[0] for r in df.select(F.length(c)).distinct().collect()) for df, c in ((words, "word"), (labels, "label"))]
    chars = F.explode(F.split("label", "")).alias("c")
    counted = labels.select(chars, "label").filter("c <> ''").groupBy("label", "c").count()
    nth = F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth")
    tokens = counted.select("c", nth).groupBy("c", "nth").count()
    top = tokens.orderBy(F.desc("count"), "c", "nth").limit(COMMON_TOKENS).collect()
    index = CharacterIndex({f"{r['c']}{r['nth']} ": r["count"] for r in top}, cutoff)
    shared = spark.sparkContext.broadcast(index)

    def keyed(df: DataFrame, name: str, others: list[int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for name_ in batch.column(0).to_pylist():
                    keys = list(own.keys(name_, others, name == "word"))
                    if keys:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name_] * len(keys))], ["key", name])

        return df.select(name).mapInArrow(run, f"key string, {name} string")

    def met(left: pa.Table, right: pa.Table) -> pa.RecordBatch | None:
        key = left.column("key")[0].as_py()
        return kernel(shared.value, key, left.column("word").to_pylist(), right.column("label").to_pylist())

    return blocked_join(
        keyed(words, "word", lengths[1]), keyed(labels, "label", lengths[0]), "key", "word", "label", met, schema, block_rows, block_rows
    )


def _words_and_labels(names: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    words = names.select(new_name(F.col("name")).alias("word")).filter(F.length("word") > 0).distinct()
    return words, labels.select(F.col("species").alias("label")).filter(F.length("label") > 0).distinct()


def suggestion_candidates(names: DataFrame, labels: DataFrame, cutoff: float = SUGGESTION_CUTOFF, block_rows: int = 1024) -> DataFrame:
    """``word, candidates``: how many known names share enough characters with each word; only these can reach the cutoff."""

    def kernel(index: CharacterIndex, key: str, words: list[str], known: list[str]) -> pa.RecordBatch | None:
        found = [(w, sum(index.meets_here(key, w, x) for x in near)) for w, near in sharing_enough(words, known, cutoff)]
        return pa.RecordBatch.from_arrays([pa.array([w for w, n in found]), pa.array([n for _, n in found])], ["word", "n"])

    words, known = _words_and_labels(names, labels)
    counts = _indexed(words, known, cutoff, kernel, "word string, n long", block_rows).groupBy("word").agg(F.sum("n").alias("n"))
    return words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("candidates"))


def suggest_names(
    names: DataFrame,
    labels: DataFrame,
    n: int = SUGGESTION_COUNT,
    cutoff: float = SUGGESTION_CUTOFF,
    block_rows: int = 1024,
) -> DataFrame:
    """Closest known names: ``word, suggestions`` for every distinct new-name spelling of ``name``.

    Words meet labels through an inverted index over characters (:class:`CharacterIndex`) that loses no pair within reach
    of the cutoff; crowded keys are split into bounded blocks. A pair is compared under its first shared key only, and only the
    best n per key leave a task.
    """

    def kernel(index: CharacterIndex, key: str, words: list[str], known: list[str]) -> pa.RecordBatch | None:
        found = close_names(words, known, n, cutoff, lambda word, label: index.meets_here(key, word, label))
        if not found:
            return None
        word, label, ratio = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(label), pa.array(ratio)], names=["word", "label", "ratio"])

    words, known = _words_and_labels(names, labels)
    scored = _indexed(words, known, cutoff, kernel, "word string, label string, ratio double", block_rows)
    order = Window.partitionBy("word").orderBy(F.desc("ratio"), F.desc("label"))
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    listed = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("s"))
    return listed.select("word", F.transform("s", lambda x: x["label"]).alias("suggestions"))
