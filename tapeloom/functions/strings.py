"""Small string helpers: stripping, urls, blob addresses, file names, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every video key is this prefix and the video's id.
WATCH_URL = "https://www.youtube.com/watch?v="


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"^(?U)\s+|\s+$", "")


def url_of(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id)


def id_after_watch(url: Column) -> Column:
    """The part after the last ``watch?v=``, or the whole url without one."""
    return F.substring_index(url, "watch?v=", -1)


def id_after_equals(url: Column) -> Column:
    """The part after the last ``=``, or the whole url without one."""
    return F.substring_index(url, "=", -1)


def blob_address(uri: Column) -> Column:
    """``struct(bucket, key)`` of ``gs://bucket/key``; the scheme may be absent."""
    rest = F.substring_index(uri, "gs://", -1)
    bucket = F.substring_index(rest, "/", 1)
    return F.struct(bucket.alias("bucket"), F.substr(rest, F.length(bucket) + 2).alias("key"))


def blob_uri(bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"gs://{bucket}/"), key)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def chunk_id(video_id: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", video_id, start.cast("string"), end.cast("string"))


def size_pretty(n_bytes: Column) -> Column:
    """Byte count for people: the largest unit that keeps at least ten of it."""
    # Unit names, each 1024 times the one before, used from 10240 on.
    units = ["bytes", "kB", "MB", "GB", "TB", "PB"]
    text = F.concat(n_bytes.cast("string"), F.lit(" bytes"))
    value = n_bytes.cast("double")
    for step, unit in enumerate(units[1:], start=1):
        scaled = F.round(value / F.lit(float(1024**step)), 0).cast("bigint")
        text = F.when(n_bytes < 10 * 1024**step, text).otherwise(
            F.concat(scaled.cast("string"), F.lit(f" {unit}"))
        )
    return text
