"""Work lists and deltas of the daily jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import times
from ..operators import joins
from ..plans import corpus, jobs
from ..plans.corpus import table, with_ctes

CLOCK = datetime(2024, 2, 1)


def _inputs(spark, sf_dir):
    return (
        corpus.video_metadata(spark, sf_dir).drop("event_type"),
        corpus.transcripts(spark, sf_dir),
        corpus.warehouse_embeddings(spark, sf_dir),
    )


def worklist_audio(spark, sf_dir):
    videos, _, _ = _inputs(spark, sf_dir)
    return jobs.audio_work_list(videos, corpus.audio(spark, sf_dir), corpus.age_restricted(spark, sf_dir), 5)


def worklist_audio_not_in(spark, sf_dir):
    videos, _, _ = _inputs(spark, sf_dir)
    return jobs.audio_work_list(
        videos, corpus.audio(spark, sf_dir), corpus.age_restricted(spark, sf_dir), 5, null_aware=True
    )


def worklist_transcribe(spark, sf_dir):
    """Transcribed so far: videos whose first turn came from the system."""
    videos, segments, _ = _inputs(spark, sf_dir)
    done = table(spark, sf_dir, "conversations").where("role = 'system'")
    done = done.select(F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("conv_id").cast("string")).alias("url"))
    return jobs.transcription_work_list(corpus.audio(spark, sf_dir), done, videos, 4, max_minutes=20)


def worklist_embed(spark, sf_dir):
    """Embedded so far: chunks of videos that are restricted."""
    _, segments, chunks = _inputs(spark, sf_dir)
    done = joins.present(chunks, corpus.age_restricted(spark, sf_dir), "video_url")
    return jobs.embedding_work_list(segments, done, 40)


def delta_metadata(spark, sf_dir):
    videos, segments, chunks = _inputs(spark, sf_dir)
    return jobs.metadata_delta(videos, corpus.enriched(spark, sf_dir), segments, chunks, corpus.served(spark, sf_dir))


def delta_metadata_not_in(spark, sf_dir):
    """A null among the served ids leaves nothing under NOT IN; without one the fresh videos stay."""
    videos, segments, chunks = _inputs(spark, sf_dir)
    counts = [
        jobs.metadata_delta(
            videos, corpus.enriched(spark, sf_dir), segments, chunks, corpus.served(spark, sf_dir, null), null_aware=True
        ).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(null).alias("with_null"), "kept")
        for null in (True, False)
    ]
    return counts[0].unionByName(counts[1])


DELTA_METADATA = """SELECT vm.id, vm.url, vm.title, vm.description, vm.publish_date, vm.length, en.video_type, en.review_score
FROM vm JOIN en ON en.id = vm.id
WHERE vm.url IN (SELECT DISTINCT url FROM tr) AND vm.url IN (SELECT DISTINCT video_url FROM wem)
  AND vm.id NOT IN (SELECT id FROM {served})"""


def delta_transcripts(spark, sf_dir):
    videos, segments, chunks = _inputs(spark, sf_dir)
    served = corpus.served(spark, sf_dir)
    return jobs.transcripts_delta(videos, segments, chunks, served, served)


DELTA_TRANSCRIPTS = """SELECT tr.url, tr.text, tr.segment_id, tr.segment_seek, tr.segment_start, tr.segment_end
FROM tr JOIN (SELECT url FROM vm WHERE url IN (SELECT DISTINCT url FROM tr)
    AND url IN (SELECT DISTINCT video_url FROM wem) AND id NOT IN (SELECT id FROM sv)) v ON v.url = tr.url
WHERE tr.url NOT IN (SELECT url FROM sv)"""


def delta_embeddings(spark, sf_dir):
    """Chunks of 50 videos that are not served yet, with their vectors' sizes."""
    _, _, chunks = _inputs(spark, sf_dir)
    served = joins.present(corpus.embeddings(spark, sf_dir).select("id", "url"), corpus.served(spark, sf_dir), "url")
    fresh = jobs.embeddings_delta(chunks.unionByName(chunks), served, 50)
    full = jobs.with_vectors(fresh, corpus.embeddings(spark, sf_dir))
    return full.withColumn("embedding", F.size("embedding"))


DELTA_EMBEDDINGS = """SELECT w.id, w.video_url AS url, w.embedding_type, w.start_segment, w.end_segment,
  w.segment_length, CAST(len(em.embedding) AS INT) AS embedding
FROM wem w JOIN em ON em.id = w.id
WHERE w.video_url IN (SELECT DISTINCT video_url FROM wem WHERE video_url NOT IN
  (SELECT em.url FROM em WHERE em.url IN (SELECT url FROM sv)) ORDER BY video_url LIMIT 50)"""


def left_anti(spark, sf_dir):
    videos, _, _ = _inputs(spark, sf_dir)
    return joins.absent(videos.select("id", "url"), corpus.served(spark, sf_dir, True), "url")


def not_in_null_aware(spark, sf_dir):
    """How many videos stay, for known urls with and without a null, and for none."""
    videos, _, _ = _inputs(spark, sf_dir)
    known = {"null": corpus.served(spark, sf_dir, True), "no null": corpus.served(spark, sf_dir)}
    known["none"] = known["null"].where("false")
    counts = [
        joins.absent_null_aware(videos.select("id", "url"), k, "url").agg(F.count(F.lit(1)).alias("kept"))
        .select(F.lit(case).alias("case"), "kept")
        for case, k in known.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def not_in_no_null(spark, sf_dir):
    videos, _, _ = _inputs(spark, sf_dir)
    return joins.absent_null_aware(videos.select("id", "url"), corpus.served(spark, sf_dir), "url")


def new_urls_until_known(spark, sf_dir):
    """Pages listed newest first against the pages whose document is labelled."""
    pages = table(spark, sf_dir, "pages")
    known = _known_pages(spark, sf_dir)
    listed = pages.select("url", F.col("page_id").alias("position"))
    return jobs.new_urls(listed, known, stop_at_most_recent=True, fresh_days=1, clock=CLOCK)


def _known_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    stamps = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("publish_date"))
    joined = pages.join(toxic, "page_id").join(stamps, "page_id")
    return joined.select("url", "publish_date", F.col("publish_date").alias("scrape_date"))


NEW_URLS = """WITH known AS (
  SELECT p.url, e.ts FROM pages p JOIN labels l ON l.doc_id = p.page_id AND l.toxic = 1
  JOIN events e ON e.event_id = p.page_id),
listed AS (SELECT url, min(page_id) AS position FROM pages GROUP BY url),
newest AS (SELECT url FROM known ORDER BY ts DESC, url LIMIT 1),
cut AS (SELECT min(position) AS c FROM listed WHERE url IN (SELECT url FROM newest))
SELECT url, position FROM listed CROSS JOIN cut
WHERE (c IS NULL OR position < c) AND url NOT IN (SELECT url FROM known)
  AND NOT coalesce((SELECT max(ts) FROM known) > TIMESTAMP '2024-02-01' - INTERVAL 1 DAY, false)"""


def freshness(spark, sf_dir):
    """Whether each event lies within 30 days of the clock, and its day by other routes."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts")
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return events.select(
        "event_id",
        times.is_fresh(ts, 30, CLOCK).alias("fresh"),
        times.is_fresh(ts, None, CLOCK).alias("never"),
        (times.from_epoch(epoch) == F.date_trunc("second", ts)).alias("epoch_round_trip"),
        (times.parse_iso(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) <= ts).alias("iso_round_trip"),
    )


CHECKS = {
    "worklist_audio": (
        worklist_audio,
        with_ctes(
            """SELECT vm.url FROM vm LEFT JOIN au ON au.video_url = vm.url
WHERE au.audio_gcr_uri IS NULL AND vm.url NOT IN (SELECT video_url FROM ag) ORDER BY vm.url LIMIT 5""",
            "vm", "au", "ag",
        ),
    ),
    "worklist_audio_not_in": (
        worklist_audio_not_in,
        with_ctes(
            """SELECT vm.url FROM vm LEFT JOIN au ON au.video_url = vm.url
WHERE au.audio_gcr_uri IS NULL AND vm.url NOT IN (SELECT video_url FROM ag) ORDER BY vm.url LIMIT 5""",
            "vm", "au", "ag",
        ),
    ),
    "worklist_transcribe": (
        worklist_transcribe,
        with_ctes(
            """SELECT DISTINCT au.video_url AS url, au.audio_gcr_uri FROM au
LEFT JOIN vm ON vm.url = au.video_url
WHERE vm.length < 1200 AND au.video_url NOT IN (
  SELECT concat('https://www.youtube.com/watch?v=', conv_id) FROM conversations WHERE role = 'system')
ORDER BY 1, 2 LIMIT 4""",
            "au", "vm",
        ),
    ),
    "worklist_embed": (
        worklist_embed,
        with_ctes(
            """SELECT tr.* FROM tr JOIN (
  SELECT DISTINCT url FROM tr WHERE url NOT IN
    (SELECT video_url FROM wem WHERE video_url IN (SELECT video_url FROM ag))
  ORDER BY url LIMIT 40) v ON v.url = tr.url""",
            "tr", "wem", "ag",
        ),
    ),
    "delta_metadata": (delta_metadata, with_ctes(DELTA_METADATA.format(served="sv"), "vm", "en", "tr", "wem", "sv")),
    "delta_metadata_not_in": (
        delta_metadata_not_in,
        with_ctes(
            f"""SELECT true AS with_null, count(*) AS kept FROM ({DELTA_METADATA.format(served="svn")}) UNION ALL
SELECT false, count(*) FROM ({DELTA_METADATA.format(served="sv")})""",
            "vm", "en", "tr", "wem", "sv", "svn",
        ),
    ),
    "delta_transcripts": (delta_transcripts, with_ctes(DELTA_TRANSCRIPTS, "tr", "vm", "wem", "sv")),
    "delta_embeddings": (delta_embeddings, with_ctes(DELTA_EMBEDDINGS, "em", "wem", "sv")),
    "left_anti": (
        left_anti,
        with_ctes("SELECT id, url FROM vm WHERE NOT EXISTS (SELECT 1 FROM svn WHERE svn.url = vm.url)", "vm", "svn"),
    ),
    "not_in_null_aware": (
        not_in_null_aware,
        with_ctes(
            """SELECT 'null' AS "case", count(*) AS kept FROM vm WHERE url NOT IN (SELECT url FROM svn) UNION ALL
SELECT 'no null', count(*) FROM vm WHERE url NOT IN (SELECT url FROM sv) UNION ALL
SELECT 'none', count(*) FROM vm WHERE url NOT IN (SELECT url FROM sv WHERE false)""",
            "vm", "sv", "svn",
        ),
    ),
    "not_in_no_null": (
        not_in_no_null,
        with_ctes("SELECT id, url FROM vm WHERE url NOT IN (SELECT url FROM sv)", "vm", "sv"),
    ),
    "new_urls_until_known": (new_urls_until_known, NEW_URLS),
    "freshness": (
        freshness,
        """SELECT event_id, ts > TIMESTAMP '2024-02-01' - INTERVAL 30 DAY AS fresh, false AS never,
  true AS epoch_round_trip, true AS iso_round_trip FROM events""",
    ),
}
