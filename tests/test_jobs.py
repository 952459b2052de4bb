"""Daily jobs: rerunning adds nothing, gates, rejects and status."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions.embed import HashedWords
from tapeloom.plans import corpus, jobs
from tapeloom.sources import documents, sinks, tables

SF = "/root/testdata/sf0.001"
CLOCK = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def videos(spark):
    return corpus.video_metadata(spark, SF).cache()


def test_enrichment_is_done_once(videos):
    first = jobs.enrich_new(videos, jobs.enrich(videos).limit(0))
    assert first.count() == videos.count()
    assert jobs.enrich_new(videos, first).count() == 0
    assert jobs.enrich_new(videos, first.limit(3), limit=2).count() == 2


def test_embedding_is_done_once(spark):
    segments = corpus.transcripts(spark, SF)
    none = corpus.warehouse_embeddings(spark, SF).limit(0)
    made = jobs.embed_new(segments, none, HashedWords(16), max_videos=6).cache()
    assert made.select("video_url").distinct().count() == 6
    rest = jobs.embed_new(segments, made, HashedWords(16), max_videos=1000)
    assert rest.select("video_url").distinct().count() == segments.select("url").distinct().count() - 6
    assert jobs.embed_new(segments, made.unionByName(rest), HashedWords(16)).count() == 0


def test_new_segments_only_for_unseen_urls(spark):
    result = spark.createDataFrame(
        [("u1", None, "en", [(0, 0, 0.0, 1.5, " hi"), (1, 7, 1.5, 2.0, "you")]), ("u2", None, "en", [(0, 0, 0.0, 1.0, "x")]), ("u3", None, "en", [])],
        schemas.TRANSCRIPTION_RESULT,
    )
    known = spark.createDataFrame([("u2",)], "url string")
    got = jobs.new_segments(result, known, CLOCK).orderBy("segment_id").collect()
    assert [(r.url, r.text, r.segment_seek, r.segment_end, r.segment_type, r.created_at) for r in got] == [
        ("u1", " hi", 0, 1.5, "small_segment", CLOCK), ("u1", "you", 7, 2.0, "small_segment", CLOCK),
    ]
    assert got[0].__fields__ == schemas.TRANSCRIPTIONS.fieldNames()


def test_freshness_gate(spark, videos):
    listed = spark.createDataFrame([("new", 0), ("new", 4), ("old", 1)], "url string, position int")
    known = spark.createDataFrame([("old", CLOCK, CLOCK)], "url string, publish_date timestamp_ntz, scrape_date timestamp_ntz")
    assert [r.url for r in jobs.new_urls(listed, known).collect()] == ["new"]
    assert jobs.new_urls(listed, known, fresh_days=1, clock=datetime(2024, 3, 1, 12)).count() == 0
    assert jobs.new_urls(listed, known, fresh_days=1, clock=datetime(2024, 3, 5)).count() == 1
    assert jobs.new_urls(listed, known.limit(0), fresh_days=1, clock=CLOCK).count() == 2
    later = spark.createDataFrame([("a", 0), ("old", 1), ("b", 2)], "url string, position int")
    assert jobs.new_urls(later, known, stop_at_most_recent=False).count() == 2


def test_metadata_rows_and_rejects(spark):
    good = '{"videoId":"a","title":"t","lengthSeconds":"61","channelId":"c","author":"n","viewCount":"5","thumbnail":{"thumbnails":[{"url":"s"},{"url":"m"},{"url":"l"}]}}'
    bare = '{"videoId":"b","title":"t","lengthSeconds":"61","channelId":"c","author":"n"}'
    bad = '{"videoId":"c","lengthSeconds":"long"}'
    raw = spark.createDataFrame([("u1", good), ("u2", bare), ("u3", bad), ("u4", "no json")], "url string, details string")
    rows, rejects = jobs.metadata_rows(raw, CLOCK)
    found = {r.url: r for r in rows.collect()}
    assert set(found) == {"u1", "u2"} and rows.columns == schemas.VIDEO_METADATA.fieldNames()
    assert (found["u1"].small_thumbnail_url, found["u1"].large_thumbnail_url, found["u1"].length) == ("s", "l", 61)
    assert found["u2"].small_thumbnail_url is None and found["u1"].scrape_date == CLOCK
    reasons = {r.url: r.reject_reason for r in rejects.collect()}
    assert reasons["u3"] == ["title", "length", "channel_id", "channel_name"] and "id" in reasons["u4"]


def test_conform_wants_required_columns(spark):
    with pytest.raises(ValueError):
        schemas.conform(spark.range(1), schemas.AUDIO)
    with pytest.raises(KeyError):
        schemas.table_schema("no such table")


def test_deltas_are_empty_after_loading(spark, videos):
    segments, chunks = corpus.transcripts(spark, SF), corpus.warehouse_embeddings(spark, SF)
    enriched = jobs.enrich(videos)
    nothing = corpus.served(spark, SF).limit(0)
    delta = jobs.metadata_delta(videos, enriched, segments, chunks, nothing)
    assert jobs.metadata_delta(videos, enriched, segments, chunks, delta).count() == 0
    text = jobs.transcripts_delta(videos, segments, chunks, nothing, nothing)
    assert jobs.transcripts_delta(videos, segments, chunks, nothing, text).count() == 0
    rows = jobs.embeddings_delta(chunks.union(chunks), corpus.embeddings(spark, SF).limit(0), 10**6)
    assert rows.count() == chunks.count()
    loaded = jobs.with_vectors(rows, corpus.embeddings(spark, SF).where("id <> '3'"))
    assert loaded.count() == chunks.count() - 1
    assert jobs.embeddings_delta(chunks, corpus.embeddings(spark, SF), 10**6).count() == 0


def test_a_failing_job_does_not_stop_the_rest(spark):
    done = []

    def fail():
        raise RuntimeError("broken")

    status = jobs.run_jobs(spark, [("one", lambda: done.append(1)), ("two", fail), ("three", lambda: done.append(3))])
    rows = {r.job: r for r in status.collect()}
    assert done == [1, 3] and rows["one"].ok and not rows["two"].ok and "broken" in rows["two"].error


def test_table_lifecycle(spark):
    sinks.initialize_tables(spark, ["audio", "age_restricted"])
    sinks.initialize_tables(spark, ["audio"])
    row = spark.createDataFrame([("u", "gs://b/u.mp3", CLOCK)], schemas.AUDIO)
    sinks.append(row, "audio")
    sinks.append(row.select("scrape_date", "audio_gcr_uri", "video_url"), "audio")
    assert spark.table("audio").count() == 2
    sinks.replace(spark.table("audio").distinct(), "audio")
    assert spark.table("audio").collect() == row.collect()
    sinks.initialize_tables(spark, ["audio"], delete_existing=True)
    assert spark.table("audio").count() == 0
    with pytest.raises(KeyError):
        sinks.initialize_tables(spark, ["nothing"])
    for name in ("audio", "age_restricted"):
        sinks.drop_table(spark, name)
        sinks.drop_table(spark, name)
    assert not spark.catalog.tableExists("audio")


def test_views_and_records(spark):
    df = tables.from_records(spark, [{"a": 1}, {"b": "x"}], "a int, b string")
    assert [tuple(r) for r in df.collect()] == [(1, None), (None, "x")]
    name = tables.temporary_view(df)
    assert spark.table(name).count() == 2
    with pytest.raises(Exception):
        tables.temporary_view(df, name)
    assert tables.temporary_view(df, name, replace=True) == name
    assert tables.drop_view(spark, name) and not tables.drop_view(spark, name)
    assert sinks.has_column(df, "a")
    added = sinks.add_column_once(df, "c", lambda d: F.col("a") + 1)
    assert sinks.add_column_once(added, "c", lambda d: F.lit(0)).first().c == 2
    assert [r[0] for r in sinks.as_json(df).collect()] == ['{"a":1,"b":null}', '{"a":null,"b":"x"}']


def test_segments_keep_a_given_stamp(spark):
    result = spark.createDataFrame([("u", "en", CLOCK, [(0, 0, 0.0, 1.0, "x")])], "url string, language string, made timestamp_ntz, segments array<struct<id int, seek int, start double, end double, text string>>")
    assert documents.segments_from_results(result, created_at=F.col("made")).first().created_at == CLOCK
