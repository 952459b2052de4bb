"""The daily jobs as a stream, stopped halfway and started again, against the batch jobs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.chunks import chunk_segments
from tapeloom.plans import jobs
from tapeloom.sources.documents import segments_from_results
from tapeloom.streaming import daily

CLOCK = datetime(2024, 5, 1)


def _details(spark):
    doc = '{"videoId":"%s","title":"%s","lengthSeconds":"%s","channelId":"c","author":"a","viewCount":"5"}'
    rows = [(f"u{i}", doc % (f"i{i}", f"A - B{i} ALBUM REVIEW", 60 + i), " 7/10") for i in range(20)]
    rows[3] = ("u3", '{"title":"no id"}', None)
    rows[11] = ("u11", "broken", None)
    return spark.createDataFrame(rows, "url string, details string, description string")


def _results(spark):
    rows = [(f"u{i}", "x", "en", [(k, 0, float(k), k + 1.0, f"word{i} text{k}") for k in range(i % 5)]) for i in range(15)]
    return spark.createDataFrame(rows, "url string, text string, language string, segments array<struct<id:int,seek:int,start:double,end:double,text:string>>")


def _land(frame, folder, parts, repeats):
    """Files that arrive one after the other, a few of which hold rows that came before."""
    frame.limit(0).write.parquet(folder)
    for k in range(parts):
        part = frame.where(F.pmod(F.xxhash64("url"), F.lit(parts)) == k)
        (part if k != repeats else frame).coalesce(1).write.mode("append").parquet(folder)


def _rows(df, drop=()):
    return sorted(map(str, df.drop(*drop).collect()))


class Stopped(Exception):
    pass


def _run_with_stops(spark, frame, folder, targets, checkpoint, stop_at):
    """Each entry ``(batch, target)`` ends the stream once, in front of that target."""
    reader = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
    left = set(stop_at)
    plain = targets.makers
    made = {
        name: (lambda rows, earlier, name=name: _stopping(targets, plain[name], name, rows, earlier, left)) for name in plain
    }
    stopping = daily.Targets(targets.root, targets.schemas, made)
    for _ in range(len(stop_at) + 1):
        try:
            daily.run_available(reader.parquet(folder), stopping, checkpoint)
        except Exception as error:
            assert "stopped here" in str(error)
    assert not left


def _stopping(targets, make, name, rows, earlier, left):
    number = len(targets.committed(rows.sparkSession))
    if (number, name) in left:
        left.remove((number, name))
        raise Stopped("stopped here")
    return make(rows, earlier)


@pytest.mark.parametrize("stop_at", [[], [(1, "rejects"), (2, "enriched")]])
def test_metadata_stream_equals_the_job(spark, tmp_path, stop_at):
    raw, folder = _details(spark), str(tmp_path / "in")
    _land(raw, folder, 4, 2)
    targets = daily.metadata_targets(str(tmp_path / "out"), CLOCK)
    _run_with_stops(spark, raw, folder, targets, str(tmp_path / "check"), stop_at)
    good, bad = jobs.metadata_rows(raw, CLOCK)
    assert _rows(targets.read(spark, "metadata")) == _rows(good)
    assert set(_rows(targets.read(spark, "rejects"))) == set(_rows(bad))
    assert _rows(targets.read(spark, "enriched")) == _rows(jobs.enrich(good))


def test_transcript_stream_equals_the_job(spark, tmp_path):
    results, folder = _results(spark), str(tmp_path / "in")
    _land(results, folder, 3, 1)
    targets = daily.transcript_targets(str(tmp_path / "out"), clock=CLOCK)
    _run_with_stops(spark, results, folder, targets, str(tmp_path / "check"), [(0, "chunks"), (2, "segments")])
    segments = segments_from_results(results, CLOCK)
    assert _rows(targets.read(spark, "segments")) == _rows(segments.select(*targets.schemas["segments"].fieldNames()))
    chunks = chunk_segments(segments, (3,))
    assert _rows(targets.read(spark, "chunks"), ["embedding"]) == _rows(chunks, ["text"])
    assert targets.read(spark, "chunks").where("size(embedding) = 0").count() == 0


def test_an_unmarked_batch_is_not_read(spark, tmp_path):
    targets = daily.metadata_targets(str(tmp_path / "out"), CLOCK)
    assert targets.read(spark, "metadata").count() == 0
    targets.write_batch(_details(spark).limit(5), 0)
    half = jobs.metadata_rows(_details(spark), CLOCK)[0]
    half.write.parquet(f"{targets.root}/metadata/batch=1")
    assert targets.committed(spark) == [0]
    assert targets.read(spark, "metadata").count() < half.count()
    before = _rows(targets.read(spark, "metadata"))
    targets.write_batch(_details(spark), 0)  # a replay of a batch that counts adds nothing
    assert _rows(targets.read(spark, "metadata")) == before
