"""Opening files by path or URI from tasks (local paths, s3://, hdfs://, file:)."""

from __future__ import annotations

import pyarrow.fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_atomically(path: str, parts: list[bytes], attempt: str) -> None:
    """Write under a name of this attempt, then move: a retried task never leaves half a file."""
    fs, target = resolve(path)
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    temporary = f"{target}.{attempt}.tmp"
    with fs.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    try:
        fs.move(temporary, target)  # replaces what an earlier attempt left, where the file system can
    except OSError:
        if fs.get_file_info(target).type != pafs.FileType.File:
            raise
        fs.delete_file(target)
        fs.move(temporary, target)


def move_files(folder: str, into: str, prefix: str) -> None:
    """Move the Parquet files of a folder into another one, their names behind ``prefix``."""
    fs, source = resolve(folder)
    _, target = resolve(into)
    fs.create_dir(target, recursive=True)
    for found in fs.get_file_info(pafs.FileSelector(source)):
        if found.is_file and found.path.endswith(".parquet"):
            fs.move(found.path, f"{target}/{prefix}{found.base_name}")
