"""Label-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecbank.settings import LABEL_CHARS, LEARNED_MARK, MAX_NAME_LENGTH

# (?U) makes the classes Unicode-aware; Spark's trim() would only remove blanks.
_OUTER_SPACE = r"(?U)^\s+|\s+$"
_INNER_SPACE = r"(?U)\s+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _OUTER_SPACE, "")


def name_key(name: Column) -> Column:
    """Loose comparison key: lower case, only letters, digits and the two gender signs."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9♀♂]+", "")


def new_name(name: Column) -> Column:
    """Canonical spelling of a name that enters the bank for the first time."""
    return F.regexp_replace(F.lower(strip(name)), _INNER_SPACE, "_")


def folder_label(name: Column) -> Column:
    """Label of a folder: underscores are blanks."""
    return F.lower(strip(F.translate(name, "_", " ")))


def is_valid_name(name: Column) -> Column:
    text = strip(name)
    return F.coalesce(
        (F.length(text) > 0) & (F.length(text) <= MAX_NAME_LENGTH) & (F.length(name_key(text)) > 0), F.lit(False)
    )


def stored_label(name: Column) -> Column:
    """Labels of exchange files have a fixed width, longer ones are cut."""
    return F.substring(name, 1, LABEL_CHARS)


def is_learned(variant: Column) -> Column:
    return F.coalesce(F.contains(variant, F.lit(LEARNED_MARK)), F.lit(False))


def variant_name(species: Column, millis: Column, seq: Column) -> Column:
    """Unique row name; the suffix is a hash of the sequence number, so a retried task repeats it."""
    suffix = F.substring(F.sha1(seq.cast("string").cast("binary")), 1, 8)
    return F.concat(species, F.lit(LEARNED_MARK), millis.cast("string"), F.lit("_"), suffix)


def pick_column(columns: list[str], candidates: tuple[str, ...], fallback: int) -> str:
    """The first candidate that exists; else the column at ``fallback`` (or the first one)."""
    for name in candidates:
        if name in columns:
            return name
    return columns[fallback] if fallback < len(columns) else columns[0]


def pick_label_and_image(columns: list[str], labels: tuple[str, ...], images: tuple[str, ...]) -> tuple[str, str]:
    """Label and image column of a dataset. If either is not found by name, both fall back by position."""
    if any(c in columns for c in labels) and any(c in columns for c in images):
        return pick_column(columns, labels, 0), pick_column(columns, images, 1)
    return columns[0], columns[1] if len(columns) > 1 else columns[0]
