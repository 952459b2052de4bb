"""Streams over the test files, run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.corpus import DESCRIPTIONS, TITLES, pick, sql_pick, sql_score, sql_video_type, table, with_ctes
from ..session import scratch_dir
from ..streaming import daily, incremental, latest
from .files import CLOCK, _results


def _run(spark, stream, label):
    root = scratch_dir(spark, label)
    incremental.run_available(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _events(spark, sf_dir):
    like = table(spark, sf_dir, "events")
    return incremental.landed(spark, sf_dir, like, "events.parquet")


def stream_enrich(spark, sf_dir):
    number = F.col("event_id")
    arriving = _events(spark, sf_dir).select(
        number.cast("string").alias("id"),
        F.concat(F.lit("event/"), number.cast("string")).alias("url"),
        pick(TITLES, number).alias("title"),
        pick(DESCRIPTIONS, number).alias("description"),
    )
    return _run(spark, incremental.enrich_stream(arriving), "stream-enrich")


def stream_dedupe(spark, sf_dir):
    arriving = _events(spark, sf_dir).select("user_id", "event_type")
    return _run(spark, incremental.first_arrivals(arriving, ["user_id", "event_type"]), "stream-dedupe")


def stream_dedupe_watermark(spark, sf_dir):
    arriving = _events(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    kept = incremental.first_arrivals(arriving, ["user_id", "event_type"], "ts", "3650 days")
    return _run(spark, kept, "stream-dedupe-watermark").select("user_id", "event_type")


def stream_daily_segments(spark, sf_dir):
    """Transcription results that land in three files, one batch each, and one file that lands twice."""
    root, results = scratch_dir(spark, "daily"), _results(spark, sf_dir)
    for k in (0, 1, 2, 1):
        results.where(F.pmod(F.xxhash64("url"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    targets = daily.transcript_targets(f"{root}/out", clock=CLOCK)
    daily.run_available(stream, targets, f"{root}/checkpoint")
    return targets.read(spark, "segments").withColumn("created_at", F.col("created_at").cast("string"))


def stream_latest(spark, sf_dir):
    """The newest event of each user, from three files whose rows are in no order."""
    root = scratch_dir(spark, "latest")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    changes = latest.newest_rows(stream, "user_id", "ts", "event_id", "3650 days", 24 * 3600 * 1000)
    latest.run_available(changes, f"{root}/out", f"{root}/checkpoint")
    row = F.max_by(F.struct("event_id", "event_type"), "batch").alias("row")
    return spark.read.parquet(f"{root}/out").groupBy("user_id").agg(row).select("user_id", "row.*")


CHECKS = {
    "stream_latest": (
        stream_latest,
        """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "stream_daily_segments": (
        stream_daily_segments,
        with_ctes(
            """SELECT url, text, 'en' AS language, '2024-02-01 00:00:00' AS created_at, 'small_segment' AS segment_type,
  segment_id, segment_seek, segment_start, segment_end FROM tr""",
            "tr",
        ),
    ),
    "stream_enrich": (
        stream_enrich,
        f"""SELECT CAST(event_id AS VARCHAR) AS id, concat('event/', event_id) AS url,
  {sql_video_type('title')} AS video_type, {sql_score('description')} AS review_score
FROM (SELECT event_id, {sql_pick(TITLES, 'event_id')} AS title, {sql_pick(DESCRIPTIONS, 'event_id')} AS description
  FROM events)""",
    ),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_dedupe_watermark": (stream_dedupe_watermark, "SELECT DISTINCT user_id, event_type FROM events"),
}
