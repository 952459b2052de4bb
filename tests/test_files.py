"""Vector files, blob listings, archives of JSON files, and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from tapeloom.plans import jobs, lookups
from tapeloom.sources import files
from tapeloom.streaming import incremental


def test_vector_files(spark, tmp_path):
    np.save(tmp_path / "a_0_3.npy", np.array([1.0, 2.0, 3.0]))
    np.save(tmp_path / "empty.npy", np.array(None, dtype=float))
    (tmp_path / "broken.npy").write_bytes(b"not a vector")
    (tmp_path / "other.txt").write_text("x")
    got = {r.id: r.embedding for r in files.read_vector_files(spark, str(tmp_path)).collect()}
    assert got == {"a_0_3": [1.0, 2.0, 3.0]}
    listed = files.list_objects(spark, str(tmp_path), "*.npy")
    assert sorted(r.stem for r in listed.collect()) == ["a_0_3", "broken", "empty"]


def test_listing_reads_no_contents(spark, tmp_path, plan_of):
    (tmp_path / "a.mp3").write_bytes(b"x" * 10)
    listed = files.list_objects(spark, str(tmp_path))
    assert listed.first().length == 10 and "content#" not in plan_of(listed)


def video(folder, name, segments, details=True):
    home = folder / name
    home.mkdir()
    if segments is not None:
        (home / "transcription.json").write_text(json.dumps({"text": "t", "segments": segments}, indent=1))
    if details:
        (home / "details.json").write_text(json.dumps({"videoId": name, "title": f"title {name}"}))


def test_archive(spark, tmp_path):
    one = [{"id": 0, "seek": 0, "start": 0.0, "end": 1.0, "text": "hé"}, {"id": 1, "seek": 0, "start": 1.0, "end": 2.0, "text": "b"}]
    video(tmp_path, "good", one)
    video(tmp_path, "empty", [])
    video(tmp_path, "silent", None)
    video(tmp_path, "bare", one, details=False)
    video(tmp_path, "known", one)
    records = files.archive_records(files.read_archive(spark, str(tmp_path)))
    assert sorted(r.video_id for r in records.collect()) == ["good", "known"]
    assert records.where("video_id = 'good'").first().details.title == "title good"
    metadata = records.select(F.col("video_url").alias("url"))
    transcripts = metadata.where(F.col("url").endswith("known"))
    rows = jobs.backfill_segments(records, metadata, transcripts).orderBy("segment_id").collect()
    assert [(r.url[-4:], r.text, r.language) for r in rows] == [("good", "hé", "en"), ("good", "b", "en")]
    assert all(r.created_at is not None for r in rows)


def test_merged_audio(spark, tmp_path):
    video(tmp_path, "a", [{"id": 0, "text": "x"}])
    records = files.archive_records(files.read_archive(spark, str(tmp_path)))
    audio = spark.sql("SELECT 'b' AS video_url, 'gs://x/b.mp3' AS audio_gcr_uri, timestamp_ntz'2024-01-01' AS scrape_date")
    merged = jobs.merge_audio(audio.union(audio), records, "x")
    assert sorted(r.audio_gcr_uri for r in merged.collect()) == ["gs://x/a.mp3", "gs://x/b.mp3"]
    listing = spark.createDataFrame([("a.mp3",)], "name string")
    assert [r.audio_gcr_uri for r in jobs.audio_with_blob(merged, listing, "x").collect()] == ["gs://x/a.mp3"]


def test_inventory_sizes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).select(F.col("id").cast("string").alias("url"))
    df.write.parquet(path)
    row = lookups.table_inventory({"t": df}, {"t": path}).first()
    assert row.video_count == 10 and row.table_size.split()[1] in ("bytes", "kB") and row.indexes_size == "0 bytes"


def test_stream_processes_new_files_only(spark, tmp_path):
    home, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("1", "u1", "A - B ALBUM REVIEW", " 7/10")]
    first = spark.createDataFrame(rows, "id string, url string, title string, description string")
    first.write.parquet(home)
    for _ in range(2):
        incremental.run_available(incremental.enrich_stream(incremental.landed(spark, home, first)), out, state)
        assert spark.read.parquet(out).count() == 1
    first.withColumn("id", F.lit("2")).write.mode("append").parquet(home)
    incremental.run_available(incremental.enrich_stream(incremental.landed(spark, home, first)), out, state)
    got = spark.read.parquet(out).orderBy("id").collect()
    assert [(r.id, r.video_type, r.review_score) for r in got] == [("1", "album_review", 7), ("2", "album_review", 7)]
