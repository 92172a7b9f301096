"""Zip archives of labelled images, and folders of images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from vecbank.functions.admission import file_extension, has_extension, parent_folder
from vecbank.functions.names import folder_label, strip
from vecbank.operators.ordered import numbered
from vecbank.settings import IMAGE_EXTENSIONS, SCAN_EXTENSIONS
from vecbank.sources.files import write_atomically


@udtf(returnType="member string, content binary")
class ZipMembers:
    """The files of one archive, one row each; a broken archive gives none."""

    def eval(self, content: bytes):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            return
        with archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, archive.read(info)


def expand_archives(
    spark: SparkSession, archives: DataFrame, extensions: Iterable[str] = IMAGE_EXTENSIONS
) -> DataFrame:
    """``archive, member, label, file_name, content`` of every image in ``archives`` (``path, content``).

    The label is the folder the image lies in, members at the root are ``unknown``. A file name that a
    label already has gets the suffix ``_1``, ``_2``, ... in (archive, member) order.
    """
    spark.udtf.register("zip_members", ZipMembers)
    members = spark.sql(
        "select a.path as archive, m.member, m.content from {archives} a, lateral zip_members(a.content) m",
        archives=archives,
    ).filter(has_extension(F.col("member"), extensions))
    folder = strip(F.translate(parent_folder(F.col("member")), "_", " "))
    named = members.withColumns(
        {
            "label": F.when(F.length(folder) > 0, folder).otherwise(F.lit("unknown")),
            "_base": F.regexp_extract("member", r"([^/]*)$", 1),
        }
    )
    counted = numbered(named, ["archive", "member"], ["label", "_base"], "_n")
    stem = F.regexp_extract("_base", r"(?s)^(.*)\.[^.]+$", 1)
    suffix = F.regexp_extract("_base", r"(\.[^.]+)$", 1)
    again = F.concat(stem, F.lit("_"), (F.col("_n") - 1).cast("string"), suffix)
    return counted.select(
        "archive", "member", "label", F.when(F.col("_n") == 1, F.col("_base")).otherwise(again).alias("file_name"),
        "content",
    )


def write_files(files: DataFrame, root: str) -> int:
    """Write ``path, content`` rows as files under ``root``; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                write_atomically(f"{root}/{path}", [content], attempt)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    written = files.select("path", "content").mapInArrow(run, "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def extract_archives(spark: SparkSession, path: str, out: str) -> int:
    """Unpack all zips under ``path`` into ``out/<label>/<file>``."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    members = expand_archives(spark, archives.select("path", "content"))
    folder = F.translate("label", " ", "_")
    return write_files(members.select(F.concat(folder, F.lit("/"), "file_name").alias("path"), "content"), out)


def _glob(extensions: Iterable[str]) -> str:
    """A file-name pattern that matches the extensions in any case."""
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "{" + ",".join(f"*{e}" for e in any_case) + "}"


def scan_image_files(
    spark: SparkSession, root: str, recursive: bool = True, extensions: Iterable[str] = SCAN_EXTENSIONS
) -> DataFrame:
    """``path, label, extension, length, content``; files of other types are not even listed."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob(extensions))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    return files.select(
        "path", folder_label(parent_folder(F.col("path"))).alias("label"),
        file_extension(F.col("path")).alias("extension"), "length", "content",
    )


def scan_images(spark: SparkSession, root: str, extensions: Iterable[str] = SCAN_EXTENSIONS) -> DataFrame:
    """``path, label, image`` with the image decoded by Spark's image source.

    ``image`` is null where a file cannot be read as a picture. WebP is not decoded.
    """
    pictures = (
        spark.read.format("image")
        .option("pathGlobFilter", _glob(extensions))
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "false")
        .load(root)
    )
    path = F.col("image.origin")
    image = F.when(F.col("image.height") > 0, F.col("image"))
    return pictures.select(path.alias("path"), folder_label(parent_folder(path)).alias("label"), image.alias("image"))
