"""Fixed-size chunks of transcript segments, and the text of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import chunk_id, id_after_watch
from .joins import expand_range, interval_join
from .rows import HOT_GROUP_ROWS, number_rows


def join_in_order(order: str, text: str, delimiter: str, strip_items: bool = False) -> Column:
    """Aggregate: the texts of a group by ascending ``order``, nulls left out.

    A group without texts gives an empty string.  Use it on groups of bounded
    size, such as the segments of one chunk.
    """
    pieces = F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order), F.col(text))))
    texts = F.transform(F.array_sort(pieces), lambda p: F.trim(p[text]) if strip_items else p[text])
    return F.array_join(texts, delimiter)


def chunk_segments(
    segments: DataFrame, sizes: Sequence[int] = (3,), hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Consecutive segments of each url, in time order, in chunks of each size.

    ``start_segment`` and ``end_segment`` are positions in the url's list; the
    last chunk keeps its nominal end.  Texts are joined with one space.
    """
    placed = number_rows(
        segments.select("url", "segment_id", "segment_start", "text"),
        ["url"], ["segment_start", "segment_id"], "position", hot_rows,
    )
    sized = placed.withColumn("segment_length", F.explode(F.array(*[F.lit(s) for s in sizes])))
    start = F.floor(F.col("position") / F.col("segment_length")) * F.col("segment_length")
    chunks = (
        sized.withColumn("start_segment", start.cast("int"))
        .groupBy("url", "segment_length", "start_segment")
        .agg(F.trim(join_in_order("position", "text", " ")).alias("text"))
    )
    end = F.col("start_segment") + F.col("segment_length")
    return chunks.select(
        chunk_id(id_after_watch(F.col("url")), F.col("start_segment"), end).alias("id"),
        F.col("url").alias("video_url"),
        F.lit("segment_chunk").alias("embedding_type"),
        "start_segment",
        end.alias("end_segment"),
        "segment_length",
        "text",
    )


# With at most this many chunk lengths, segments find their chunks by arithmetic.
GRID_LENGTHS = 8


def _grid_lengths(chunks: DataFrame) -> list[int] | None:
    """The lengths of the chunks if every start is a multiple of its length."""
    length = F.col("end_segment") - F.col("start_segment")
    on_grid = (length > 0) & (F.col("start_segment") % F.nullif(length, F.lit(0)) == 0)
    kinds = chunks.select(length.alias("n"), on_grid.alias("fits")).distinct().limit(GRID_LENGTHS + 1).collect()
    if len(kinds) > GRID_LENGTHS or not all(k["fits"] for k in kinds):
        return None
    return [k["n"] for k in kinds]


def _on_grid(chunks: DataFrame, segments: DataFrame, lengths: list[int]) -> DataFrame:
    """Left join of chunks to their segments on url, length and start.

    The group-by that follows has these among its keys, so the segments are
    shuffled once; joining on single segment ids would shuffle them twice.
    """
    sized = segments.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
    start = (F.floor(F.col("segment_id") / F.col("_length")) * F.col("_length")).cast("int")
    keyed = chunks.withColumn("_length", F.col("end_segment") - F.col("start_segment"))
    return keyed.join(sized.withColumn("start_segment", start), ["url", "_length", "start_segment"], "left")


def chunk_to_text(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per chunk with the joined text and time bounds of its segments.

    Texts are joined without a delimiter; a chunk without segments keeps its
    row, with an empty text and null bounds.
    """
    keys = ["id", "url", "start_segment", "end_segment"]
    chunks = chunks.select(*keys)
    parts = segments.select("url", "segment_id", "text", "segment_start", "segment_end")
    lengths = _grid_lengths(chunks)
    if lengths:
        joined, groups = _on_grid(chunks, parts, lengths), [*keys, "_length"]
    else:
        joined, groups = interval_join(chunks, parts, "url", "segment_id", how="left"), keys
    texts = joined.groupBy(*groups).agg(
        join_in_order("segment_id", "text", "").alias("text"),
        F.min("segment_start").alias("segment_start"),
        F.max("segment_end").alias("segment_end"),
    )
    return texts.select(*keys, "text", "segment_start", "segment_end")


# Shares of the urls, by hash, that a stored table of chunk texts is partitioned by.
TEXT_BUCKETS = 1024


def url_bucket(buckets: int = TEXT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")


def refresh_chunk_text(
    chunks: DataFrame, segments: DataFrame, path: str, changed: DataFrame | None = None, buckets: int = TEXT_BUCKETS
) -> None:
    """Bring the stored texts of chunks below ``path`` up to date.

    The table is partitioned by a hash of the url.  With ``changed``, a frame with a
    column ``url`` of everything that is new, only the buckets that hold such a url are
    worked out and replaced; the files of the others stay as they are.  Without it,
    all buckets are written.  Every chunk and segment of a touched bucket is read, so the
    result equals a full rebuild; a url that lost all its chunks needs a full one.

    A bucket is replaced as a whole when the job commits.  The urls of one batch touch at
    most ``buckets`` partitions, whose numbers become literals of the scans.
    """
    placed = url_bucket(buckets)
    if changed is not None:
        dirty = sorted(r[0] for r in changed.select(placed.alias("bucket")).distinct().collect())
        if not dirty:
            return
        chunks, segments = (df.where(placed.isin(*dirty)) for df in (chunks, segments))
    texts = chunk_to_text(chunks, segments).withColumn("bucket", placed)
    # Rows of a bucket meet in one task unless it is large, so that it gets few files.
    writer = texts.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite")
    writer.option("partitionOverwriteMode", "static" if changed is None else "dynamic").parquet(path)


def with_spaced_text(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """``chunks`` with their text: segments stripped and joined with a space.

    Repeated segments count once.  A chunk without segments gets an empty text.
    """
    keys = ["url", "id"]
    once = segments.groupBy("url", "segment_id").agg(F.min("text").alias("_piece"))
    wanted = chunks.select(*keys, "start_segment", "end_segment").distinct()
    found = expand_range(wanted, "start_segment", "end_segment", "segment_id").select(*keys, "segment_id")
    texts = (
        found.join(once, ["url", "segment_id"])
        .groupBy(*keys)
        .agg(join_in_order("segment_id", "_piece", " ", strip_items=True).alias("_text"))
    )
    return (
        chunks.join(texts, keys, "left")
        .withColumn("text", F.coalesce(F.col("_text"), F.lit("")))
        .drop("_text")
    )
