"""Stored chunk texts that follow changed videos only."""

import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.chunks import chunk_to_text, refresh_chunk_text, url_bucket
from tapeloom.plans import corpus

SF = "/root/testdata/sf0.001"
BUCKETS = 64


def _files(path):
    """Partition folders with the names and times of their files."""
    found = {}
    for folder in os.listdir(path):
        if folder.startswith("bucket="):
            own = os.path.join(path, folder)
            found[folder] = sorted((f, os.stat(os.path.join(own, f)).st_mtime_ns) for f in os.listdir(own) if f.endswith("parquet"))
    return found


def _rows(df):
    return sorted(map(tuple, df.select("id", "url", "start_segment", "end_segment", "text", "segment_start", "segment_end").collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return corpus.embeddings(spark, SF).select("id", "url", "start_segment", "end_segment"), corpus.transcripts(spark, SF)


@pytest.mark.parametrize("share", [17, 100])
def test_only_touched_buckets_are_rewritten(spark, tables, tmp_path, share):
    chunks, segments = tables
    late = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(share)) == 0
    path = str(tmp_path / "text")
    refresh_chunk_text(chunks.where(~late), segments.where(~late), path, buckets=BUCKETS)
    before = _files(path)
    changed = chunks.where(late).select("url").union(segments.where(late).select("url"))
    touched = {f"bucket={r[0]}" for r in changed.select(url_bucket(BUCKETS)).distinct().collect()}
    refresh_chunk_text(chunks, segments, path, changed, BUCKETS)
    after = _files(path)
    assert {b for b in after if after[b] != before.get(b)} == touched & after.keys()
    assert len(touched) < BUCKETS
    assert _rows(spark.read.parquet(path)) == _rows(chunk_to_text(chunks, segments))


def test_new_segments_of_known_chunks(spark, tmp_path):
    """Segments that come later change the text and bounds of chunks that are stored already."""
    chunks = spark.createDataFrame([("a", "u1", 0, 3), ("b", "u1", 3, 6), ("c", "u2", 0, 3)], "id string, url string, start_segment int, end_segment int")
    schema = "url string, segment_id int, text string, segment_start double, segment_end double"
    first = [("u1", 0, "x", 0.0, 1.0), ("u2", 0, "z", 0.0, 1.0)]
    later = [("u1", 1, "y", 1.0, 2.0), ("u1", 4, None, 4.0, 5.0)]
    path = str(tmp_path / "text")
    refresh_chunk_text(chunks, spark.createDataFrame(first, schema), path, buckets=8)
    new = spark.createDataFrame(later, schema)
    refresh_chunk_text(chunks, spark.createDataFrame(first + later, schema), path, new, 8)
    texts = {r.id: (r.text, r.segment_start, r.segment_end) for r in spark.read.parquet(path).collect()}
    assert texts == {"a": ("xy", 0.0, 2.0), "b": ("", 4.0, 5.0), "c": ("z", 0.0, 1.0)}


def test_nothing_changed(spark, tables, tmp_path):
    chunks, segments = tables
    path = str(tmp_path / "text")
    refresh_chunk_text(chunks, segments, path, buckets=8)
    before = _files(path)
    refresh_chunk_text(chunks, segments, path, chunks.limit(0), 8)
    assert _files(path) == before
