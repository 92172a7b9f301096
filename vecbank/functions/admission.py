"""Rules that decide whether an input is taken: URLs, payloads, file names, sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecbank.settings import IMAGE_EXTENSIONS, MAX_UPLOAD_BYTES, MIN_LOCAL_SIDE, MIN_REMOTE_SIDE


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_admission(url: Column, suffixes: Iterable[str], exact_hosts: Iterable[str] = ()) -> Column:
    """``ok``, ``bad_url`` or ``host_not_allowed``.

    ``suffixes`` start with a dot and also admit the bare domain. A URL whose host Java cannot read
    (an underscore in it, say) is a bad URL.
    """
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = url_host(url)
    user = F.try_parse_url(url, F.lit("USERINFO"))
    # An empty "user:password" part ("@host", ":@host") names nobody and is accepted.
    names_user = F.coalesce(F.length(F.regexp_replace(user, "^:|:$", "")) > 0, F.lit(False))
    plain = scheme.isin("http", "https") & (F.length(host) > 0) & ~names_user
    allowed = F.lit(False)
    for suffix in suffixes:
        allowed = allowed | (host == suffix[1:]) | host.endswith(suffix)
    exact = [h.lower() for h in exact_hosts]
    if exact:
        allowed = allowed | host.isin(exact)
    return (
        F.when(~F.coalesce(plain, F.lit(False)), "bad_url").when(~allowed, "host_not_allowed").otherwise("ok")
    )


def payload_admission(content: Column, limit: int = MAX_UPLOAD_BYTES) -> Column:
    """``ok``, ``empty`` or ``too_large``."""
    size = F.octet_length(content)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > limit, "too_large").otherwise("ok")
    )


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the last path part has none."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"(?s)^.+(\.[^.]+)$", 1))


def has_extension(path: Column, extensions: Iterable[str] = IMAGE_EXTENSIONS) -> Column:
    return file_extension(path).isin(list(extensions))


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def is_large_enough(width: Column, height: Column, local: Column) -> Column:
    """Local images need more than 10 pixels a side, remote ones at least 10."""
    side = F.least(width, height)
    return F.when(local, side >= MIN_LOCAL_SIDE).otherwise(side >= MIN_REMOTE_SIDE)


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


def content_hash(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def pixel_hash(width: Column, height: Column, data: Column) -> Column:
    """Hash of the picture: the shape is part of it, so equal bytes in another shape differ."""
    return F.md5(F.concat(F.concat_ws("x", width, height).cast("binary"), F.lit(":").cast("binary"), data))
