"""Nested documents and file contents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.strings import WATCH_URL
from ..plans import corpus, jobs
from ..plans.corpus import table, with_ctes
from ..sources import documents, files

CLOCK = datetime(2024, 2, 1)
# Segments per nested result, so that no result grows with its video.
BLOCK = 100


def _nested(spark, sf_dir):
    """Conversations as transcription results of at most ``BLOCK`` segments."""
    turn = F.col("turn")
    segment = F.struct(
        turn.cast("int").alias("id"),
        (turn * 1000).cast("int").alias("seek"),
        (turn * 7.5).cast("double").alias("start"),
        (turn * 7.5 + 7.5).cast("double").alias("end"),
        "text",
    )
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(turn / BLOCK).alias("block"))
    return grouped.agg(F.array_sort(F.collect_list(segment)).alias("segments")).withColumn("video_id", F.col("conv_id").cast("string"))


def _results(spark, sf_dir):
    return _nested(spark, sf_dir).select(
        F.concat(F.lit(WATCH_URL), "video_id").alias("url"), F.lit(None).cast("string").alias("text"),
        F.lit("en").alias("language"), "segments",
    )


def segments_from_results(spark, sf_dir):
    """Results of videos without a transcript; signups have one."""
    known = corpus.served(spark, sf_dir)
    rows = jobs.new_segments(_results(spark, sf_dir), known, CLOCK)
    return rows.withColumn("created_at", F.col("created_at").cast("string"))


SEGMENTS = """SELECT url, text, 'en' AS language, '2024-02-01 00:00:00' AS created_at, 'small_segment' AS segment_type,
  segment_id, segment_seek, segment_start, segment_end FROM tr WHERE url NOT IN (SELECT url FROM sv)"""


def vector_files(spark, sf_dir):
    """Vectors through the bytes of vector files and back."""
    rows = table(spark, sf_dir, "embeddings")
    written = rows.select(
        F.concat(F.lit("/vectors/"), F.col("vec_id").cast("string"), F.lit(".npy")).alias("path"),
        files.encode_npy(F.col("embedding")).alias("content"),
    )
    read = files.decode_vector_files(written)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read.select("id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


def _archive(spark, sf_dir):
    """Archive documents of the conversations; purchases have no details."""
    nested = _nested(spark, sf_dir)
    spoken = nested.select(
        "video_id", F.lit("transcription.json").alias("document"), F.to_json(F.struct("segments")).alias("value")
    )
    videos = corpus.video_metadata(spark, sf_dir).where("event_type <> 'purchase'")
    described = videos.select(
        F.col("id").alias("video_id"), F.lit("details.json").alias("document"),
        F.to_json(F.struct(F.col("id").alias("videoId"), "title")).alias("value"),
    )
    return spoken.unionByName(described).withColumn("created_at", F.lit(CLOCK).cast("timestamp_ntz"))


def json_archive(spark, sf_dir):
    records = files.archive_records(_archive(spark, sf_dir))
    return records.select("video_id", "video_url", "details.title", F.explode("segments.id").alias("segment_id"))


def backfill(spark, sf_dir):
    """Archived segments of known videos without a transcript; signups have one."""
    archive = files.archive_records(_archive(spark, sf_dir))
    rows = jobs.backfill_segments(archive, corpus.video_metadata(spark, sf_dir), corpus.served(spark, sf_dir))
    return rows.withColumn("created_at", F.col("created_at").cast("string"))


BACKFILL = f"{SEGMENTS} AND url IN (SELECT url FROM vm WHERE event_type <> 'purchase')"


def merge_audio(spark, sf_dir):
    videos = corpus.video_metadata(spark, sf_dir)
    archive = videos.where("event_type <> 'error'").select(
        F.col("id").alias("video_id"), F.col("url").alias("video_url"), F.lit(CLOCK).cast("timestamp_ntz").alias("created_at")
    )
    merged = jobs.merge_audio(corpus.audio(spark, sf_dir), archive, "archive")
    return merged.withColumn("scrape_date", F.col("scrape_date") == F.lit(CLOCK).cast("timestamp_ntz"))


def audio_with_blob(spark, sf_dir):
    """Audio rows whose file is in a listing that holds labelled videos only."""
    listing = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".mp3")).alias("name"))
    return jobs.audio_with_blob(corpus.audio(spark, sf_dir), listing, "audio").drop("scrape_date")


def details_flatten(spark, sf_dir):
    """Metadata rows from JSON details with one, two or no thumbnails."""
    videos = corpus.video_metadata(spark, sf_dir)
    pictures = F.filter(
        F.array(
            F.when(F.col("event_type") != "error", F.struct(F.concat(F.lit("small/"), "id").alias("url"))),
            F.when(F.col("event_type") == "view", F.struct(F.concat(F.lit("large/"), "id").alias("url"))),
        ),
        lambda p: p.isNotNull(),
    )
    doc = F.struct(
        F.col("id").alias("videoId"), "title", F.col("length").cast("string").alias("lengthSeconds"),
        F.lit("c1").alias("channelId"), F.lit("channel").alias("author"),
        F.col("description").alias("shortDescription"), F.lit("12").alias("viewCount"),
        F.struct(pictures.alias("thumbnails")).alias("thumbnail"),
    )
    raw = videos.select("url", "publish_date", F.to_json(doc).alias("details"))
    return documents.flatten_details(raw, CLOCK).drop("scrape_date")


CHECKS = {
    "segments_from_results": (segments_from_results, with_ctes(SEGMENTS, "tr", "sv")),
    "vector_files": (
        vector_files,
        """SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INT) AS dims,
  round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
    ),
    "json_archive": (
        json_archive,
        with_ctes(
            """SELECT vm.id AS video_id, vm.url AS video_url, vm.title, tr.segment_id
FROM vm JOIN tr ON tr.url = vm.url WHERE vm.event_type <> 'purchase'""",
            "vm", "tr",
        ),
    ),
    "backfill_segments": (backfill, with_ctes(BACKFILL, "tr", "sv", "vm")),
    "merge_audio": (
        merge_audio,
        with_ctes(
            """SELECT video_url, audio_gcr_uri, false AS scrape_date FROM au UNION ALL
SELECT url, concat('gs://archive/', id, '.mp3'), true FROM vm
WHERE event_type <> 'error' AND url NOT IN (SELECT video_url FROM au)""",
            "au", "vm",
        ),
    ),
    "audio_with_blob": (
        audio_with_blob,
        with_ctes(
            """SELECT video_url, audio_gcr_uri FROM au
WHERE audio_gcr_uri IN (SELECT concat('gs://audio/', doc_id, '.mp3') FROM labels)""",
            "au",
        ),
    ),
    "details_flatten": (
        details_flatten,
        with_ctes(
            """SELECT id, title, CAST(length AS BIGINT) AS length, 'c1' AS channel_id, 'channel' AS channel_name,
  description AS short_description, CAST(NULL AS VARCHAR) AS description, CAST(12 AS BIGINT) AS view_ct, url,
  CASE WHEN event_type <> 'error' THEN concat('small/', id) END AS small_thumbnail_url,
  CASE WHEN event_type = 'view' THEN concat('large/', id)
    WHEN event_type <> 'error' THEN concat('small/', id) END AS large_thumbnail_url, publish_date FROM vm""",
            "vm",
        ),
    ),
}
