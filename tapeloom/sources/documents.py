"""Nested transcription results and video details to flat rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import now
from ..schemas import VIDEO_DETAILS, VIDEO_METADATA


def segments_from_results(
    results: DataFrame, clock: datetime | None = None, created_at: Column | None = None
) -> DataFrame:
    """One transcript row per segment of ``url, language, segments``.

    Rows are stamped with the clock, or with a column of the results.
    """
    stamp = now(clock) if created_at is None else created_at
    return results.select(
        "url", "language", stamp.alias("created_at"), F.explode("segments").alias("segment")
    ).select(
        "url",
        F.col("segment.text").alias("text"),
        "language",
        "created_at",
        F.lit("small_segment").alias("segment_type"),
        F.col("segment.id").alias("segment_id"),
        F.col("segment.seek").alias("segment_seek"),
        F.col("segment.start").alias("segment_start"),
        F.col("segment.end").alias("segment_end"),
    )


def flatten_details(raw: DataFrame, clock: datetime | None = None, details: str = "details") -> DataFrame:
    """Metadata rows from raw details documents.

    ``raw`` has ``url`` and ``details`` (JSON text or a struct), and may have
    ``publish_date`` and ``description``.
    """
    doc = F.col(details)
    if dict(raw.dtypes)[details] == "string":
        doc = F.from_json(doc, VIDEO_DETAILS)
    flat = raw.withColumn("_doc", doc)
    thumbs = F.col("_doc.thumbnail.thumbnails.url")

    def optional(name: str) -> Column:
        kind = VIDEO_METADATA[name].dataType
        return (F.col(name) if name in raw.columns else F.lit(None)).try_cast(kind).alias(name)

    return flat.select(
        F.col("_doc.videoId").alias("id"),
        F.col("_doc.title").alias("title"),
        F.col("_doc.lengthSeconds").try_cast("bigint").alias("length"),
        F.col("_doc.channelId").alias("channel_id"),
        F.col("_doc.author").alias("channel_name"),
        F.col("_doc.shortDescription").alias("short_description"),
        optional("description"),
        F.col("_doc.viewCount").try_cast("bigint").alias("view_ct"),
        "url",
        F.try_element_at(thumbs, F.lit(1)).alias("small_thumbnail_url"),
        F.try_element_at(thumbs, F.lit(-1)).alias("large_thumbnail_url"),
        optional("publish_date"),
        now(clock).alias("scrape_date"),
    )
